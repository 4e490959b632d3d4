"""BPE encoding and decoding with merge rounds over flat numpy arrays.

The vocabulary file (its path is a parameter) is read once on the driver and broadcast;
its size is fixed by the file. Words that a worker hasn't met are encoded together, many at
once: their symbols lie in one flat array, each round looks all adjacent pairs up by binary
search over the sorted pair keys, finds the lowest rank of every word, and merges there.
Finished words leave the array. A long word is merged alone: its pairs are taken up by rank, a
bounded number of places at once, and a merge touches its two neighbours only, so the work stays
near linear in a word of any length. A word's ids and decoded form are kept in a bounded cache.

Nulls and empty texts have no ids and decode to the empty text. Texts of any length are
encoded whole, in parts of bounded size. Repeated rows give repeated rows; an empty table gives none; only doc_id
and text are read, whatever else the table holds.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import ready, sliced, table

#: Code points of text that are split into pieces at once.
SEGMENT = 1 << 20
#: Bytes from which a word is merged alone, and its places that are open at once.
LONG, OPEN = 256, 4096
#: Words that a worker remembers; beyond that it forgets all and starts again.
CACHE_WORDS = 300_000

# Fixed values of the file format: the word pattern after lower-casing, and white space.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Lower case of capitals that Python's own tables don't know yet.
_NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {
    c: c + 0x20 for c in range(0x10D50, 0x10D66)
}
#: Blocks with the letters of Unicode 16, which the library knows and Python 3.13 doesn't.
_UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4),
    (0x11380, 0x113FF), (0x116D0, 0x116E3), (0x11BC0, 0x11BFF), (0x13460, 0x143FF), (0x16100, 0x1613F),
    (0x16D40, 0x16D7F), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF),
)
_AT_SPACE = re.compile(f"[{_SPACE}]+")
#: Texts of ASCII, Latin letters and common punctuation, on which the faster module agrees with the pattern.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ɏ‐-‧]*")
_PLAIN_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a BPE file whose words end in a suffix."""

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.n = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.n
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        suffix = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs (their number where a pair doesn't merge) and their places among the keys."""
        key = left * self.n + right
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.ranks[found], len(self.keys)), found

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one word; symbols are a linked list, of which the places of the lowest ranks are open."""
        flat = np.frombuffer(word, np.uint8)
        syms = self.inner[flat]
        syms[-1] = self.last[flat[-1]]
        n, none = len(syms), len(self.keys)
        if n < 2 or not none:
            return syms
        # place n stands for the end; a symbol that is merged away keeps rank ``none``
        syms = np.r_[syms, -1]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n + 1, bool)
        rank = np.full(n + 1, none, np.int64)
        rank[: n - 1] = self._ranks(syms[: n - 1], syms[1:n])[0]
        while True:
            rest = np.flatnonzero(rank < none)
            if not len(rest):
                break
            below = none if len(rest) <= OPEN else int(np.partition(rank[rest], OPEN)[OPEN]) + 1
            open_ = rest[rank[rest] < below]
            while len(open_):
                least = rank[open_].min()
                place = np.unique(open_[rank[open_] == least])
                if len(place) > 1:  # in a run of one overlapping pair every other place is merged, from the left
                    head = np.r_[True, after[place[:-1]] != place[1:]]
                    first = np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
                    place = place[(np.arange(len(place)) - first) % 2 == 0]
                made = self.made[self._ranks(syms[place[:1]], syms[after[place[:1]]])[1][0]]
                gone = after[place]
                rank[gone], alive[gone] = none, False
                after[place] = after[gone]
                before[after[place]] = place
                syms[place] = made
                changed = np.concatenate([place, before[place]])
                changed = changed[changed >= 0]
                last = after[changed] >= n
                rank[changed] = np.where(last, none, self._ranks(syms[changed], syms[np.minimum(after[changed], n)])[0])
                open_ = np.concatenate([open_, changed])
                open_ = open_[rank[open_] < below]
        return syms[:n][alive[:n]]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (none empty, as UTF-8) one after another, and where each ends."""
        long = {i: self.encode_long(w) for i, w in enumerate(words) if len(w) > LONG}
        if not long:
            return self._encode_short(words)
        flat, end = self._encode_short([w if i not in long else w[:1] for i, w in enumerate(words)])
        parts = np.split(flat, end[:-1])
        for i, ids in long.items():
            parts[i] = ids
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def _encode_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(size)
        syms = self.inner[flat]
        syms[end - 1] = self.last[flat[end - 1]]
        word = np.repeat(np.arange(len(words)), size)
        none = len(self.keys)
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(syms):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(syms), none, np.int64)
            at = np.zeros(len(syms), np.int64)
            inside = np.flatnonzero(word[1:] == word[:-1])
            if len(inside) and none:
                rank[inside], at[inside] = self._ranks(syms[inside], syms[inside + 1])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(syms)]))
            gone = least == none
            if gone.any():
                ready.append((word[gone], syms[gone]))
            # in a run of one overlapping pair ("aaa"), every other place is merged, from the left
            place = np.flatnonzero((rank == least) & ~gone)
            if len(place):
                head = np.r_[True, np.diff(place) > 1]
                first = place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
                place = place[(place - first) % 2 == 0]
                syms[place] = self.made[at[place]]
                gone[place + 1] = True
            syms, word = syms[~gone], word[~gone]
        if not ready:
            return np.empty(0, np.int64), end
        word = np.concatenate([w for w, _ in ready])
        syms = np.concatenate([x for _, x in ready])
        order = np.argsort(word, kind="stable")
        return syms[order], np.cumsum(np.bincount(word, minlength=len(words)))


def _newer_letters() -> str:
    """Letters and numbers of the regex module that the file's library doesn't know yet."""
    import regex

    known = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return "".join(
        c for c in regex.findall(r"[\p{L}\p{N}]", known)
        if unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= z for a, z in _UNICODE_16)
    )


class Coder:
    """Encodes and decodes texts; remembers words up to a bound."""

    def __init__(self, vocab: Vocabulary, cache: int = CACHE_WORDS):
        import regex

        self.vocab, self.limit = vocab, cache
        newer = _newer_letters()
        self.newer = frozenset(newer)
        word = _WORD.replace(r"\s", _SPACE)
        self.words = regex.compile(word)
        # slower, for texts that hold one of those letters, which count as symbols
        word = word.replace(r"[\p{L}]", rf"[\p{{L}}--[{newer}]]").replace(r"[\p{N}]|", rf"[\p{{N}}--[{newer}]]|")
        word = word.replace(r"\p{L}\p{N}]+", rf"[\p{{L}}--[{newer}]][\p{{N}}--[{newer}]]]+")
        self.words_newer = regex.compile(word, regex.V1)
        self.special = re.compile("|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) or "(?!)")
        self.id_text = np.array([str(i) for i in range(vocab.n)], object)
        self.tokens = np.array(vocab.tokens, object)
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def _words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            return _PLAIN_WORD.findall(unicodedata.normalize("NFC", text).lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().translate(_NEWER_LOWER)
        return (self.words if self.newer.isdisjoint(text) else self.words_newer).findall(text)

    def _learn(self, words: set[str]) -> None:
        missing = [w for w in words if w not in self.ids]
        if not missing:
            return
        if len(self.ids) + len(missing) > self.limit:
            self.ids, self.decoded = {}, {}
            missing = list(words)
        flat, end = self.vocab.encode_words([w.encode() for w in missing])
        ids, tokens = self.id_text[flat].tolist(), self.tokens[flat].tolist()
        at = 0
        for w, to in zip(missing, end.tolist(), strict=True):
            self.ids[w], self.decoded[w] = " ".join(ids[at:to]), " ".join(tokens[at:to])
            at = to

    def segments(self, texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        """The texts as lists of (place, part of a text), each list of a bounded length in all.

        Texts are cut at white space only, and so never inside a special token.
        """
        held: list[tuple[int, str]] = []
        room = SEGMENT
        for k, text in enumerate(texts):
            at, n = 0, len(text or "")
            while at < n:
                cut = _AT_SPACE.search(text, at + SEGMENT) if n - at > SEGMENT else None
                to = cut.start() if cut else n
                if to - at > room and held:
                    yield held
                    held, room = [], SEGMENT
                held.append((k, text if to - at == n else text[at:to]))
                room -= to - at
                at = to
        if held:
            yield held

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special tokens (False) and those tokens (True)."""
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def code(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(place, ids in decimal joined by a space, decoded form) of the texts' parts in their order; none are empty."""
        for held in self.segments(texts):
            split: list[tuple[int, list[str], bool]] = []
            for k, t in held:
                for part, special in self._parts(t) if "<" in t else ((t, False),):
                    words = [part] if special else self._words(part)
                    if words:
                        split.append((k, words, special))
            self._learn({w for _, words, special in split if not special for w in words})
            for k, words, special in split:
                if special:
                    yield k, str(self.vocab.special[words[0]]), words[0]
                else:
                    yield k, " ".join(map(self.ids.__getitem__, words)), " ".join(map(self.decoded.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for _, ids, _ in self.code([text]) for x in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the file names no decoder; unknown ids are left out."""
        return " ".join(self.vocab.tokens[i] for i in ids if 0 <= i < self.vocab.n)


_coders: dict[str, Coder] = {}


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for."""
    spark = docs.sparkSession
    ready(spark)
    with open(path, encoding="utf-8") as file:
        read = file.read()
    content, mark = spark.sparkContext.broadcast(read), hashlib.sha256(read.encode()).hexdigest()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if mark not in _coders:
            _coders[mark] = Coder(Vocabulary(content.value))
        coder = _coders[mark]
        for batch in sliced(batches):
            n = batch.num_rows
            counts, flat = np.zeros(n, np.int64), []
            ids_sha, decoded_sha = ([hashlib.sha256() for _ in range(n)] for _ in range(2))
            for k, ids, decoded in coder.code(batch.column(1).to_pylist()):
                if counts[k]:
                    ids_sha[k].update(b" ")
                    decoded_sha[k].update(b" ")
                ids_sha[k].update(ids.encode())
                decoded_sha[k].update(decoded.encode())
                counts[k] += ids.count(" ") + 1
                if with_ids:
                    flat.append(np.fromstring(ids, np.int32, sep=" "))
            columns = [batch.column(0), pa.array(counts), *[pa.array([h.hexdigest() for h in x]) for x in (ids_sha, decoded_sha)]]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                every = pa.array(np.concatenate([np.empty(0, np.int32), *flat]))
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), every))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_path())
