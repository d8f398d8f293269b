"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsieve.llm.chat import CLOSE, OPEN, collapsed
from flowsieve.llm.common import table
from flowsieve.llm.exact_dedup import exact_duplicates
from flowsieve.llm.hilbert_shards import BITS, DIMENSIONS, SHARDS, curve_steps, digest, sharded
from flowsieve.llm.html_extract import extracted
from flowsieve.llm.language import identified
from flowsieve.llm.line_dedup import ENDS, without_repeated_passages
from flowsieve.llm.minhash import near_duplicates
from flowsieve.llm.nn_descent import near_vectors
from flowsieve.llm.packing import packed
from flowsieve.llm.phrases import LEAST, SHARE, TOP, collocations
from flowsieve.llm.pieces import encoded
from flowsieve.llm.token_files import read_tokens, write_tokens
from flowsieve.llm.whitening import whitened
from flowsieve.session import scratch_path

QUERIES, ORACLES = {}, {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@_query("op1_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))


@_query("op2_exact_dedup", """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
      sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents")).drop("n_chunks")


@_query("op3_chat_format", f"""WITH seg AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
      num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos, '{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE[:-1]}' || chr(10) AS segment FROM seg),
      pre AS (SELECT *, array_agg({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, count(*) OVER (PARTITION BY conv_id) AS n_turns,
        sum(length(segment)) OVER (PARTITION BY conv_id ORDER BY pos) - length(segment) AS start FROM num),
      who AS (SELECT upto, min(conv_id) AS conv_id FROM pre WHERE pos + 1 = n_turns GROUP BY upto),
      stay AS (SELECT conv_id FROM who WHERE upto NOT IN (SELECT upto FROM pre WHERE pos + 1 < n_turns))
      SELECT conv_id, pos, role, segment, CAST(start AS BIGINT) AS start, n_turns, coalesce(role = 'assistant', false) AS bears_loss FROM pre JOIN stay USING (conv_id)""")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return collapsed(table(spark, folder, "conversations"))


@_query("op4_line_dedup", f"""WITH ln AS (SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
      ro AS (SELECT *, substr(md5(coalesce(lag(md5(line)) OVER w, '') || md5(line)), 1, 1) IN ({', '.join(repr(c) for c in ENDS)}) AS e FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      ch AS (SELECT *, coalesce(sum(CAST(e AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ro),
      bo AS (SELECT doc_id, k, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM ch GROUP BY ALL),
      ge AS (SELECT doc_id, k, n, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) > 1 AS gone FROM bo WHERE n > 1),
      al AS (SELECT ch.doc_id, i, line, coalesce(gone, false) AS gone, coalesce(gone AND ch.k IS DISTINCT FROM lag(ch.k) OVER (PARTITION BY ch.doc_id ORDER BY i), false) AS head FROM ch LEFT JOIN ge USING (doc_id, k))
      SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS lines_removed, count(*) FILTER (head) AS chunks_removed FROM al GROUP BY doc_id""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_passages(table(spark, folder, "documents"))


@_query("op6_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


@_query("op7_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_path(spark, "token-table")
    write_tokens(table(spark, folder, "documents"), place)
    return read_tokens(spark, place)


@_query("op9_minhash")
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=2)


@_query("op5_nn_descent")
def nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@_query("op8_html_extract")
def html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(table(spark, folder, "pages"))


@_query("op10_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identified(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def _shard_sql() -> str:
    """Cells by rank, the curve as nested projections, checksums by half bytes (DuckDB has no crc32)."""
    nibbles = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        nibbles.append(n)
    cells = ", ".join(f"(rank() OVER (ORDER BY {d} NULLS FIRST) - 1) * {1 << BITS} // count(*) OVER () AS x{i}" for i, d in enumerate(DIMENSIONS))
    curve = f"SELECT *, 0 AS curve, {cells} FROM own"
    for step in curve_steps(len(DIMENSIONS), BITS, lambda a, b: f"xor({a}, {b})"):
        curve = f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in step.items())}) FROM ({curve})"
    order = ", ".join(["curve", *(f"{d} NULLS FIRST" for d in DIMENSIONS), "digest", "doc_id NULLS FIRST"])
    return f"""WITH own AS (SELECT doc_id, lang, source, strlen(coalesce(text, '')) + 8 AS size, md5(coalesce(text, '')) AS digest, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
      ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS r, count(*) OVER () // {SHARDS} AS q, count(*) OVER () % {SHARDS} AS m FROM ({curve})),
      halves AS (SELECT *, list_prepend(4294967295, flatten(list_transform(range(1, len(h), 2), lambda i: [instr('0123456789ABCDEF', h[i + 1]) - 1, instr('0123456789ABCDEF', h[i]) - 1]))) AS s FROM ranked)
      SELECT doc_id, size, xor(list_reduce(s, lambda a, b: xor(a >> 4, {nibbles}[(xor(a, b) & 15) + 1])), 4294967295) AS text_crc32, 'rows' AS law,
        CAST(CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // greatest(q, 1) END AS INTEGER) AS shard,
        CASE WHEN r < m * (q + 1) THEN r % (q + 1) ELSE (r - m * (q + 1)) % greatest(q, 1) END AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM halves"""


@_query("op11_hilbert_shards", _shard_sql())
def hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return digest(sharded(table(spark, folder, "documents")))


@_query("op12_whitening")
def whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"))


@_query("op13_phrases", f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
      lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
      total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
      grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS p FROM lists, (VALUES (1), (2), (3)) AS v(m)),
      f AS (SELECT lang, m, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
      cuts AS (SELECT lang, p, f AS a, k, p[1:k] AS p1, p[k + 1:m] AS p2 FROM f, (VALUES (1), (2)) AS v(k) WHERE k < m),
      parts AS (SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = p1 JOIN f y ON y.lang = c.lang AND y.p = p2),
      lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
      covered AS (SELECT lang, p[j:j + 1] AS p, max(f) AS f FROM f, (VALUES (1), (2)) AS v(j) WHERE m = 3 GROUP BY ALL),
      stay AS (SELECT x.*, array_to_string(x.p, ' ') AS phrase FROM lowest x LEFT JOIN covered y ON y.lang = x.lang AND y.p = x.p WHERE len(x.p) = 3 OR y.f IS NULL OR 100 * y.f < {SHARE} * a)
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
      FROM stay JOIN total USING (lang) QUALIFY rank <= {TOP}""")
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
