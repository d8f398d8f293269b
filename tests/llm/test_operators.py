"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from flowsieve.llm import chat, exact_dedup, html_extract, language, line_dedup, minhash, nn_descent, packing, pieces, token_files
from flowsieve.llm.tokens import Encoder, tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, comp bigint, n int, key string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [(1, "a b c d e f", "en"), (2, "a b c d e f", "en"), (3, None, None), (4, "", "en"), (5, LONG, "de"), (5, LONG, "de"), (None, "a b", None), (6, "12 !?", "fr"), (7, "one", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "src0", 1, 2, "k") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def _ids(path, text):
    library = Encoder(path).library
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_segments_encode_like_whole_texts():
    rng = random.Random(1)
    marks = "ab AB\t\n\r\x0b\x1c\x85\xa0 !?1'sé́ß字Σς<|endoftext|>"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(400)] + ["<|endoftext|> x", "it's 12a,b  c\n\n d "]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encode = Encoder(tokenizer_path(name))
        for text, ids in zip(texts, encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == encode.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_keep_their_ids(name):
    import tokenizers

    untouched, encode = tokenizers.Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name))
    rng = random.Random(14)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "|>", "a", "It's", " ", "\n", "e\u0301", "\u0301", "12", "!"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", *("".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(500))]
    assert [np.frombuffer(i, "<u4").tolist() for i in encode(texts)] == [untouched.encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_bounds_change_no_ids(monkeypatch):
    monkeypatch.setattr("flowsieve.llm.tokens.REMEMBERED", 5)
    monkeypatch.setattr("flowsieve.llm.tokens.TOGETHER", 3)
    path = tokenizer_path("byte_bpe_50k.json")
    encode = Encoder(path)
    texts = [" ".join(f"w{k * j % 17}" for k in range(12)) for j in range(8)] + ["x" * 100, ""]
    own = [_ids(path, t)[:-1].tolist() for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in encode(texts)] == own and len(encode.known) == 5
    encode.between = None
    assert [np.frombuffer(i, "<u4").tolist() for i in encode(texts)] == own
    with pytest.raises(TypeError):
        encode(["unseen words", None])
    assert not encode.known and np.frombuffer(encode(["unseen words"])[0], "<u4").tolist() == _ids(path, "unseen words")[:-1].tolist()


def test_pieces_are_the_librarys(docs, none, spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  thein\n!.,'éß字0123()ﬁ😀") for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in [*texts, "", "   a", "a" * 700, " " * 90, LONG[:4000]]:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == library.encode(text) == list(own.stream(own.normalized(text)))
        assert own.decode(ids) == text
    found = pieces.encoded(docs, with_ids=True)
    assert found.count() == len(ROWS) and found.where("not round_trip").count() == 0
    assert sorted(r["text"] for r in pieces.decoded(found).collect()) == sorted(r[1] or "" for r in ROWS)
    assert pieces.encoded(none).count() == 0


def test_unigram_pieces_give_the_best_sum(tmp_path):
    own = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))
    own.bpe, own.scores = False, {k: -float(len(k) % 3) - 1.0 - (hash(k) % 7) / 8 for k in own.scores}
    own.lowest = min(own.scores.values()) - 10
    for text in ["thein the onst", "aabbaabbab" * 6]:
        chars = own.normalized(text)
        best = [0.0] + [-1e9] * len(chars)
        for end in range(1, len(chars) + 1):
            for start in range(max(0, end - own.longest), end):
                best[end] = max(best[end], best[start] + own.scores.get(chars[start:end], -1e9))
        assert sum(own.scores[own.names[i]] for i in own.stream(chars)) == pytest.approx(best[-1])


def test_exact_duplicates(docs, none, rows):
    found = rows(exact_dedup.exact_duplicates(docs))
    assert len(found) == len(ROWS)
    by = {(r["doc_id"], r["text_sha256"]): r for r in found}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert by[1, digest("a b c d e f")]["keep_id"] == 2 and not by[1, digest("a b c d e f")]["kept"]
    assert by[3, digest("")]["keep_id"] == 4 and by[3, digest("")]["group_size"] == 2
    assert [r["kept"] for r in found if r["doc_id"] == 5].count(True) == 1
    assert by[None, digest("a b")]["kept"]
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_chunks_resist_shifts():
    data = np.random.default_rng(3).integers(97, 110, 60_000, dtype=np.uint8).tobytes()
    ends = set(exact_dedup.cuts(data))
    assert len(ends & {e - 7 for e in exact_dedup.cuts(b"shifted" + data)}) >= len(ends) - 3


def test_snapshots_collapse(spark, rows):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None), (4, 0, "user", None), (5, 0, "user", ""), (None, 0, "user", "x"), (6, 0, None, "a")]
    table = spark.createDataFrame([(*t, 0) for t in turns], "conv_id bigint, turn bigint, role string, text string, size int")
    found = rows(chat.collapsed(table), "conv_id", "pos")
    assert [(r["conv_id"], r["pos"]) for r in found] == [(2, 0), (2, 1), (4, 0), (5, 0), (6, 0)]
    assert found[1]["start"] == len(found[0]["segment"]) and found[1]["bears_loss"]
    assert chat.collapsed(table.limit(0)).count() == 0


def test_line_passages(docs, none, spark, rows):
    rng = random.Random(4)
    line = lambda: "".join(rng.choice("abcde ") for _ in range(30))
    passage = [line() for _ in range(12)]
    texts = [(k, "\n".join([line() for _ in range(5)] + passage + [line() for _ in range(4)]), None, None, 1, 2, "k") for k in (10, 11, 12)]
    found = {r["doc_id"]: r for r in rows(line_dedup.without_repeated_passages(spark.createDataFrame(texts, DOCS)))}
    assert found[10]["lines_removed"] == 0 and found[11]["lines_removed"] >= 6 and found[12]["lines_removed"] >= 6
    plan = line_dedup.without_repeated_passages(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert {r["text"] for r in rows(line_dedup.without_repeated_passages(docs))} == {r[1] or "" for r in ROWS}
    assert line_dedup.without_repeated_passages(none).count() == 0


def test_near_vectors(spark, rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16)) * 0.25, rng.normal(size=(100, 16))])
    table = [(i, [float(v) for v in row], 0.0) for i, row in enumerate(x)] + [(900, [float(2 * v) for v in x[0]], 0.0)]
    odd = [(901, None, 0.0), (902, [0.0] * 16, 0.0), (903, [float("nan")] * 16, 0.0), (904, [], 0.0), (None, [1.0] * 16, 0.0), (905, [None] + [1.0] * 15, 0.0)]
    frame = spark.createDataFrame(table + odd, "vec_id bigint, embedding array<double>, cos double")
    found = {r["vec_id"]: r for r in rows(nn_descent.near_vectors(frame))}
    full = np.concatenate([x, 2 * x[:1]])
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    got = np.array([found[i]["n_links"] for i, _, _ in table])
    assert got.sum() >= 0.98 * links.sum() and (got <= links.sum(1)).all()
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in (901, 902, 903, 904, 905))
    assert nn_descent.near_vectors(frame.limit(0)).count() == 0


def test_dense_versions_meet(spark, rows):
    # ten tight versions of one text: every list of 12 is full of its own version
    rng = np.random.default_rng(11)
    base = rng.normal(size=32)
    versions = base + rng.normal(size=(10, 32)) * 0.2 * np.linalg.norm(base) / 32 ** 0.5
    x = np.repeat(versions, 40, 0) + rng.normal(size=(400, 32)) * 0.02
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    found = {r["vec_id"]: r for r in rows(nn_descent.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")))}
    assert {r["component_id"] for r in found.values()} == {0}
    assert [found[i]["n_links"] for i in range(400)] == (links.sum(1) - 1).tolist()


def test_blocks_give_every_link_to_the_classes():
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(4, 16)), 30, 0) + rng.normal(size=(120, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(120)
    edges = nn_descent._best(ids, x, 0.5, ids)
    assert edges["link"].sum() == 116 and (edges["cos"][edges["link"]] >= 0.9).all()
    assert (edges["away"] == (edges["u"] // 30 != edges["w"] // 30)).all()


def test_audit_judges_small_groups_apart(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 32)), 200, 0) + rng.normal(size=(200, 32)) * 0.01, np.repeat(rng.normal(size=(5, 32)), 2, 0) + rng.normal(size=(10, 32)) * 0.01])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    distinct = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    # the large group is one class and no pair is found: 39,800 of 39,810 link ends
    classes = spark.createDataFrame([(i, 0) for i in range(200)], "v bigint, comp bigint")
    assert nn_descent.recall(distinct, classes) == [(0, 10), (200, 200)]


def test_missed_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "recall", lambda *_: [(1, 2), (3, 3)])
    monkeypatch.setattr(nn_descent, "MOST_TABLES", nn_descent.TABLES)
    with pytest.raises(RuntimeError, match="1, 2"):
        nn_descent.near_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id bigint, embedding array<double>")).count()


def test_packing(docs, none, rows):
    path = tokenizer_path("word_bpe_49k.json")
    found = rows(packing.packed(docs, with_ids=True))
    assert packing.packed(none).count() == 0
    whole: dict = {}
    for r in sorted(found, key=lambda r: (str(r["doc_id"]), r["start"])):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        whole.setdefault(r["doc_id"], bytearray()).extend(r["ids"])
    assert bytes(whole[1]) == _ids(path, ROWS[0][1]).tobytes() and bytes(whole[3]) == (2).to_bytes(4, "little")
    filled: dict = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 4096


def test_packing_limits():
    limits = packing.Limits(tokens=100, segments=4, loss=40)
    packer, used = packing.Packer(limits, pool=8), {}
    rng = random.Random(6)
    items = [(k, 0, n := rng.randrange(1, 150), rng.randrange(0, n + 1)) for k in range(200)]
    placed = [*packer.feed(items), *packer.feed([], last=True)]
    for (key, _, n, loss), sequence, _ in placed:
        total = used.setdefault(sequence, [0, 0, 0])
        total[0], total[1], total[2] = total[0] + n, total[1] + 1, total[2] + loss
    assert all(a <= 100 and b <= 4 and c <= 40 for a, b, c in used.values())
    assert sum(p[0][2] for p in placed) == sum(i[2] for i in items) and sum(p[0][3] for p in placed) == sum(i[3] for i in items)


@pytest.mark.parametrize("bits", [1, 3, 11, 16, 17, 20])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    data = token_files.pack_bits(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8
    for start, n in ((0, 1001), (5, 7), (999, 2), (0, 0)):
        assert (token_files.unpack_bits(data, n, bits, start) == ids[start:start + n]).all()


def test_token_files(docs, none, spark, rows, tmp_path):
    path = tokenizer_path("byte_bpe_50k.json")
    token_files.write_tokens(docs, f"{tmp_path}/t", size=1000)
    found = rows(token_files.read_tokens(spark, f"{tmp_path}/t"))
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in ROWS), key=lambda k: -1 if k is None else k)
    assert np.cumsum([0] + [r["n_tokens"] for r in found])[:-1].tolist() == [r["start"] for r in found]
    for r in found:
        text = next(t for k, t, _ in ROWS if k == r["doc_id"])
        assert r["ids_crc32"] == zlib.crc32(_ids(path, text).tobytes())
    token_files.write_tokens(none, f"{tmp_path}/e")
    assert token_files.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_pages(spark, rows):
    crf = html_extract.fitted()
    rng, wrong, seen = np.random.default_rng(77), 0, 0
    for _ in range(100):
        blocks = html_extract.blocks(html_extract.labelled_page(rng))
        truth = [int(bool(p) and "data-main" in p[-1][1]) for p, _, _ in blocks]
        got = html_extract.viterbi(np.array([crf.score(html_extract.block_features(p, html_extract.look(t, k))) for p, t, k in blocks]), crf)
        wrong, seen = wrong + sum(a != b for a, b in zip(truth, got)), seen + len(truth)
    assert wrong <= 0.02 * seen
    page = ('<body><nav><ul><li><a href="/">Home</a></ul></nav><script>var t="</p>";</script><div class="ad">Buy.</div><article><h1>A &amp; b</h1>'
            '<p>One \n two<br>three.<p>Four &eacute; five, and more of it.</article><footer>&copy; x &middot; y.</footer>')
    frame = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", page, "t")], "page_id bigint, url string, html string, text string")
    found = rows(html_extract.extracted(frame), "page_id")
    assert [r["text"] for r in found] == ["A & b\nOne two three.\nFour é five, and more of it.", "", "", "A & b\nOne two three.\nFour é five, and more of it."]
    assert html_extract.extracted(frame.limit(0)).count() == 0


def test_pages_with_an_open_head():
    def read(page):
        return [(p[-1][0], t) for p, t, _ in html_extract.blocks(page)]
    body = [("h1", "A"), ("p", "One two.")]
    assert read("<html><head><title>t</title><body><h1>A</h1><p>One two.</p></body></html>") == body
    assert read("<html><head><title>t</title><style>x</style><h1>A</h1><p>One two.</p></html>") == body
    assert read("<html><head><noscript><img src=x><p>no</p></noscript><body><h1>A</h1><p>One two.") == body
    assert read("<html><head><meta name=x> One <b>two</b>.</html>") == [("html", "One two.")]
    assert read("<html><head><title>t</title></head><body><h1>A</h1><p>One two.</p></body></html>") == body
    page = "<html><head><title>t</title><body><article><h1>A title</h1><p>One two three, and more of it. Four five.</article>"
    assert html_extract.Extractor(html_extract.fitted())(page) == "A title\nOne two three, and more of it. Four five."


def test_all_name_tokens_count():
    classes = " ".join(f"col{k}" for k in range(20))
    (path, _, _), = html_extract.blocks(f'<div class="{classes} sidebar">x</div>')
    assert path[-1][1][-1] == "sidebar"


def test_near_documents(docs, none, spark, rows):
    rng = random.Random(9)
    texts = []
    for k in range(120):
        if k % 3 and texts:
            words = texts[-1].split()
            for _ in range(rng.randrange(1, 7)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(500)}"
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 80))))
    frame = spark.createDataFrame([(k, t, None, None, 1, 2, "k") for k, t in enumerate(texts)], DOCS)
    sets = [{tuple(w[i:i + 2]) for i in range(len(w) - 1)} for w in (t.split() for t in texts)]
    names = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((names[a], names[b]))
                names = [low if n == high else n for n in names]
    found = rows(minhash.near_duplicates(frame, size=2))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {k: (len(sets[k]), names[k]) for k in range(len(texts))}
    odd = {r["doc_id"]: r for r in rows(minhash.near_duplicates(docs, size=5))}
    assert odd[2]["component_id"] == 1 and odd[3]["kept"] and odd[3]["n_shingles"] == 0 and odd[None]["kept"] and odd[7]["n_shingles"] == 1
    assert minhash.near_duplicates(none).count() == 0


def test_language(spark, docs, none, rows):
    words = {"en": "the and of to in that with shall", "de": "der und die nicht mit für über schön", "fr": "le et les des avec être dans où"}
    rng = random.Random(10)
    table = [(k, " ".join(rng.choice(words[c].split()) for _ in range(30)), c, "s", 1, 2, "k") for k, c in enumerate(sorted(words) * 40)]
    mixed = table + [(500, None, None, "s", 1, 2, "k"), (501, "123 !", "en", "s", 1, 2, "k"), (None, "der die und", None, "s", 1, 2, "k")]
    found = language.identified(spark.createDataFrame(mixed, DOCS))
    got = {r["doc_id"]: r for r in rows(found)}
    assert found.columns == [*docs.columns, "held_out", "lang_pred", "score"]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(120))
    assert all(got[k]["lang_pred"] == c for k, _, c, *_ in table)
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[None]["lang_pred"] == "de"
    assert language.identified(none).count() == 0
    crf = language.fit_languages({c: [t[1] for t in table if t[2] == c] for c in words})
    p = language.Labeller(crf).word_probabilities([["the", "and", "of", "that", "der", "die", "nicht", "und"]])[0]
    assert [crf.labels[i] for i in p.argmax(1)] == ["en"] * 4 + ["de"] * 4


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 40)
    # one id a thousand times, one row a thousand times, a language of long texts alone
    table = [(3, f"the {k}", "en") for k in range(1000)] + [(4, "the and", "en")] * 1000 + [(k, f"of {k}", "en") for k in range(100)]
    table += [(k, "der die " * 30_000, "de") for k in range(30)]
    texts = language.sample(spark.createDataFrame(table, "doc_id bigint, text string, lang string"))
    assert len(texts["en"]) == len(set(texts["en"])) == 40 and any(t.startswith("of ") for t in texts["en"])
    assert len(texts["de"]) == 4 and {len(t) for t in texts["de"]} == {10 * language.SAMPLE_CHARS}


def test_marginals_are_those_of_all_labellings():
    import itertools

    rng = np.random.default_rng(3)
    score, crf = rng.normal(size=(5, 3)), language.Crf(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    paths = list(itertools.product(range(3), repeat=5))
    total = np.array([crf.start[p[0]] + sum(score[k, y] for k, y in enumerate(p)) + sum(crf.moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
    weight = np.exp(total) / np.exp(total).sum()
    expected = np.array([[sum(w for w, p in zip(weight, paths) if p[k] == y) for y in range(3)] for k in range(5)])
    gamma, _ = language.marginals(np.exp(score - score.max(1, keepdims=True)), np.array([5]), crf)
    assert np.allclose(gamma, expected)
    assert list(html_extract.viterbi(score, crf)) == list(paths[int(total.argmax())])


def test_pipeline(spark, none, tmp_path):
    import corpus_pipeline

    none.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.schema(T.StructType(none.select("doc_id", "text", "lang", "source").schema)).parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).columns == docs.columns
