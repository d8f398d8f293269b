"""Whole-text ids by the tokenizers library, each distinct segment encoded once.

Both public vocabularies split a text before every run of white space, and behind a letter that an ASCII mark or digit
follows, before they merge. So the ids of a text are those of its segments one after another. A worker remembers segments
up to a bound and asks the library only for the others. The library takes a vocabulary's added tokens (<|endoftext|>) out of a
text before all else, so each is a segment of its own. The tests compare this with encoding whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

# fixed values: the characters with Unicode's White_Space property, ASCII marks and digits, Latin letters
SPACE = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MARK, LETTER = r"!-@\[-`{-~", "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
SEGMENT = re.compile(f"[{SPACE}]*+(?:[{MARK}]*+[{LETTER}]++(?:(?=[{MARK}])|[^{SPACE}]*+)|[^{SPACE}]++)|[{SPACE}]++")
END_ID = 2
#: Segments a worker remembers, the longest of them, and how many go to the library in one call.
REMEMBERED, LONGEST, TOGETHER = 700_000, 64, 100


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Met(dict):
    """Ids of the segments met. One met for the first time gets an empty buffer, filled when its batch has been cut."""

    def __init__(self):
        self.new: dict[str, bytearray] = {}

    def __missing__(self, segment: str) -> bytearray:
        self[segment] = self.new[segment] = bytearray()
        return self[segment]


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; remembers at most ``REMEMBERED`` segments of a worker."""

    def __init__(self, path: str):
        # a task owns one core: the library's own threads would spin beside the other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        # the longest of those that begin at one place is taken
        self.added = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        # an added token that takes nothing beside it and overlaps no other stands between segments encoded in one call
        plain = [(t.content, i) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized) and not any(
            t.content.startswith(o[-n:]) or t.content.endswith(o[:n]) for o in self.added for n in range(1, len(o)))]
        self.between = min(plain, default=None)
        self.known = _Met()

    def segments(self, text: str) -> list[str]:
        if not any(a in text for a in self.added):
            return SEGMENT.findall(text)
        # every second part is an added token
        return [s for k, part in enumerate(self.apart.split(text)) for s in ([part] if k % 2 else SEGMENT.findall(part))]

    def _encoded(self, segments: list[str]) -> list[bytes]:
        """Each segment's ids."""
        if self.between is None or any(a in segments for a in self.added):
            return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(segments, add_special_tokens=False)]
        mark, number = self.between
        ids = np.array(self.library.encode(mark.join(segments), add_special_tokens=False).ids, "<u4")
        ends = [*(4 * np.flatnonzero(ids == number)).tolist(), 4 * len(ids)]
        data = ids.tobytes()
        return [data[:ends[0]], *(data[start + 4:end] for start, end in zip(ends, ends[1:]))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        room, known.new = REMEMBERED - len(known), {}
        try:
            rows = [list(map(known.__getitem__, self.segments(t))) for t in texts]
            new, names = known.new, list(known.new)
            for start in range(0, len(names), TOGETHER):
                for s, ids in zip(names[start:start + TOGETHER], self._encoded(names[start:start + TOGETHER])):
                    new[s].extend(ids)
                    if room > 0 and len(s) <= LONGEST:
                        known[s] = ids
                        room -= 1
                    else:
                        del known[s]
        except BaseException:
            # some buffers are still empty
            known.clear()
            raise
        known.new = {}
        return [b"".join(row) for row in rows]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker's encoder: it outlives the task, so the next task starts with what this one has met."""
    return Encoder(path)
