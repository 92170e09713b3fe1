"""Counts and ids of whole texts by a public tokenizer, one library call for each new chunk between white space.

The word-level tokenizers split at white space before any merge, and neither their normaliser nor their
special strings reach over white space, so a text's ids are its chunks' ids in order. Chunks recur, so a
worker keeps the ids of those it has met: in a young store, which takes the place of an old one when it is half of
CACHE_ENTRIES large, and what is met again in the old one moves to the young.
"""

from __future__ import annotations

import os
from array import array

#: Chunks a Python worker remembers; about 200 bytes each.
CACHE_ENTRIES = 800_000
#: Longer chunks are encoded each time and never stored.
CACHE_CHUNK_BYTES = 48
#: Chunks that go to the library as one text, and the mark between them.
CHUNKS_IN_A_TEXT = 500
MARK = "\u00b6"

_loaded: dict[str, "ChunkEncoder"] = {}


def _keeps_to_words(normalizer: dict | None) -> bool:
    """True where a normaliser changes nothing across white space: Unicode forms, lower case, and white space made one space."""
    if normalizer is None:
        return True
    kind = normalizer.get("type")
    if kind == "Sequence":
        return all(map(_keeps_to_words, normalizer["normalizers"]))
    if kind == "Replace":
        return normalizer["pattern"] == {"Regex": r"\s+"} and normalizer["content"] == " "
    return kind in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")


def splits_at_white_space(path: str) -> bool:
    """True for a tokenizers file whose normaliser keeps to words, whose pre-tokenizer drops white space and whose special strings have none."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    split = steps[0]
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    no_space = all(
        t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["single_word"])
        for t in spec.get("added_tokens", [])
    )
    return bool(drops and no_space and _keeps_to_words(spec.get("normalizer")) and spec.get("truncation") is None and spec.get("padding") is None)


class ChunkEncoder:
    """ids of texts as little-endian unsigned 32-bit integers, by one tokenizer file (.json or .model)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.by_chunk = path.endswith(".json") and splits_at_white_space(path)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.n_ids = model.get_piece_size()
            self._library = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.n_ids = tokenizer.get_vocab_size()
            self._library = lambda texts: [
                e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
        self.mark = array("I", self._library([MARK])[0]).tobytes()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "ChunkEncoder":
        """The worker's own encoder of the file; workers are reused between tasks."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """ids of chunks, many to a library call with a mark between them that no chunk holds."""
        out = []
        for k in range(0, len(chunks), CHUNKS_IN_A_TEXT):
            texts = [c.decode("utf-8") for c in chunks[k : k + CHUNKS_IN_A_TEXT]]
            joined = f" {MARK} ".join(texts)
            found: list[bytes] = []
            if joined.count(MARK) == len(texts) - 1:
                found = _split(array("I", self._library([joined])[0]).tobytes(), self.mark)
            if len(found) != len(texts):
                found = [array("I", x).tobytes() for x in self._library(texts)]
            out += found
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text, in order; none for null."""
        if not self.by_chunk:
            return [array("I", x).tobytes() for x in self._library([t or "" for t in texts])]
        split = [t.encode("utf-8").split() if t else [] for t in texts]
        if len(self.young) > CACHE_ENTRIES // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing: set[bytes] = set()
        for words in split:
            missing.update(words)
        missing.difference_update(young)
        for word in missing.intersection(old):
            young[word] = old[word]
        fresh = list(missing.difference(old))
        young.update(zip(fresh, self._encode(fresh)))
        out = [b"".join([young[w] for w in words]) for words in split]
        for word in fresh:
            if len(word) > CACHE_CHUNK_BYTES:
                del young[word]
        return out


def _split(ids: bytes, mark: bytes) -> list[bytes]:
    """Parts of packed ids between the marks, which start at whole ids only."""
    out, begin, at = [], 0, ids.find(mark)
    while at >= 0:
        if at % 4:
            at = ids.find(mark, at + 1)
            continue
        out.append(ids[begin:at])
        begin = at + len(mark)
        at = ids.find(mark, begin)
    out.append(ids[begin:])
    return out
