"""Token counts (3): edit-aware, over a segment tree of pre-tokens for each document."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ids_only, read_table, small_batches, tokenizer_path

#: Pre-tokens of a leaf of the tree, at first.
LEAF = 32
#: Characters after a pre-token that can decide where it ends (a blank and what follows it, or a contraction).
AHEAD = 2
#: Pre-tokens whose counts are remembered; then the memory starts anew.
REMEMBERED = 300_000
# Fixed value: the pattern that splits text before the merges of the vocabulary, as its README states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Edit = tuple[int, int, str]


class Counter:
    """Tokens of a pre-token, by the vocabulary's own merges."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        try:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        except FileNotFoundError:
            raise FileNotFoundError(f"no vocabulary at {path}: the file must lie there on every worker, or give its path") from None
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        got = list(map(self.known.get, pieces))
        if None in got:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for i, n in enumerate(got):
                if n is None:
                    p = pieces[i]
                    if (n := self.known.get(p)) is None:
                        n = len(self.encoding.encode_ordinary(p))
                        if len(p) < 64:
                            self.known[p] = n
                    got[i] = n
        return got


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


class CountTree:
    """A segment tree over the pre-tokens of one document. Each leaf is a run of them; each node sums the characters,
    pre-tokens and tokens below it.

    replace() re-encodes the leaves that an edit touches, with the context before it that lookahead can reach, and
    goes on to the right only until a pre-token ends where one ended before; then it updates the sums above."""

    def __init__(self, text: str, count: Counter, leaves: list[tuple[int, int, int]] | None = None, leaf: int = LEAF):
        self.count, self.leaf, self.encoded = count, leaf, 0
        if leaves is None:
            pieces = count.pieces(text)
            leaves = self._leaves(pieces, count.counts(pieces))
            self.encoded = len(pieces)
        self.texts, at = [], 0
        for chars, _, _ in leaves:
            self.texts.append(text[at : at + chars])
            at += chars
        self._build(leaves)

    def _leaves(self, pieces: list[str], counts: list[int]) -> list[tuple[int, int, int]]:
        n = self.leaf
        return [(sum(map(len, pieces[i : i + n])), len(pieces[i : i + n]), sum(counts[i : i + n])) for i in range(0, len(pieces), n)]

    def _build(self, leaves: list[tuple[int, int, int]]) -> None:
        self.cap = 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = [(0, 0, 0)] * (2 * self.cap)
        self.sums[self.cap : self.cap + len(leaves)] = leaves
        for i in range(self.cap - 1, 0, -1):
            self._sum(i)
        self.size = len(leaves)

    def _sum(self, i: int) -> None:
        (a, b, c), (x, y, z) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = a + x, b + y, c + z

    @property
    def leaves(self) -> list[tuple[int, int, int]]:
        return self.sums[self.cap : self.cap + self.size]

    @property
    def totals(self) -> tuple[int, int, int]:
        return self.sums[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf with the character at that place, where the leaf starts); the last leaf for the end of the text."""
        i, start = 1, 0
        at = min(at, self.sums[1][0] - 1)
        while i < self.cap:
            i *= 2
            if at - start >= self.sums[i][0]:
                start += self.sums[i][0]
                i += 1
        return i - self.cap, start

    def replace(self, start: int, end: int, new: str) -> None:
        """Put new in place of the characters from start to before end."""
        if not self.size:
            self.__init__(new, self.count, leaf=self.leaf)
            return
        first, at = self._find(max(0, start - AHEAD))
        last, last_at = self._find(max(start, end - 1))
        old_end = last_at + len(self.texts[last])
        old = "".join(self.texts[first : last + 1])
        region = old[: start - at] + new + old[end - at :]
        while True:
            tail, nxt = "", last + 1
            while len(tail) < AHEAD and nxt < self.size:
                tail += self.texts[nxt]
                nxt += 1
            pieces, reached = [], 0
            for m in self.count.pattern.finditer(region + tail):
                if reached >= len(region):
                    break
                pieces.append(m.group())
                reached = m.end()
            if reached == len(region) or last + 1 >= self.size:
                break
            last += 1
            region += self.texts[last]
            old_end += len(self.texts[last])
        counts = self.count.counts(pieces)
        self.encoded += len(pieces)
        slots = last - first + 1
        if len(pieces) > 4 * self.leaf * slots:  # much new text: make more leaves
            made = self._leaves(pieces, counts)
            texts, lo = [], 0
            for chars, _, _ in made:
                texts.append(region[lo : lo + chars])
                lo += chars
            leaves = self.leaves
            self.texts[first : last + 1] = texts
            leaves[first : last + 1] = made
            self._build(leaves)
            return
        cut, lo = [len(pieces) * i // slots for i in range(slots + 1)], 0
        for i in range(slots):
            part = pieces[cut[i] : cut[i + 1]]
            chars = sum(map(len, part))
            self.texts[first + i] = region[lo : lo + chars]
            lo += chars
            self.sums[self.cap + first + i] = chars, len(part), sum(counts[cut[i] : cut[i + 1]])
        lo, hi = (self.cap + first) // 2, (self.cap + last) // 2
        while lo:
            for i in range(lo, hi + 1):
                self._sum(i)
            lo, hi = lo // 2, hi // 2

    def edit(self, edits: list[Edit]) -> int:
        """Apply edits (places in the text as it was), and say how many: of overlapping ones the first by start, then
        end, applies; places beyond the text count as its end."""
        length, done, kept = self.sums[1][0], 0, []
        for start, end, new in sorted(edits):
            start, end = min(max(start, 0), length), min(max(end, start), length)
            if start >= done and (end > start or new):
                kept.append((start, end, new))
                done = end
        for e in reversed(kept):
            self.replace(*e)
        return len(kept)


_LEAVES = "array<struct<chars:int,pieces:int,tokens:int>>"
_LEAF_TYPE = pa.list_(pa.struct([("chars", pa.int32()), ("pieces", pa.int32()), ("tokens", pa.int32())]))


def _as_rows(leaves: list[tuple[int, int, int]]) -> list[dict]:
    return [{"chars": a, "pieces": b, "tokens": c} for a, b, c in leaves]


def count_tokens(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, text, n_pieces, n_tokens and leaves (the leaf level of the tree: all that recounting needs) of each row.

    docs: doc_id, text; other columns are ignored. path: a file of ranks, read where the tasks run, so it must
    lie there on every worker (else the job fails and says so). Null or empty
    text: no tokens, no leaves. Whole texts; one pass, no shuffle. Repeated rows each return a row. Empty: no rows."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    kind = ids_only(docs, ("doc_id",)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [CountTree(t.as_py() or "", counter(path), leaf=leaf) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), pa.array([t.totals[1] for t in trees], pa.int64()), pa.array([t.totals[2] for t in trees], pa.int64()), pa.array([_as_rows(t.leaves) for t in trees], _LEAF_TYPE)],
                ["doc_id", "text", "n_pieces", "n_tokens", "leaves"],
            )

    small_batches(docs.sparkSession)
    return ids_only(docs, ("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, text string, n_pieces long, n_tokens long, leaves {_LEAVES}")


def recount_tokens(counted: DataFrame, edits: Callable[[str], list[Edit]] | None = None, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Counts after edits, from the counts before: count_tokens()'s columns with the new text, leaves and counts, and
    n_pieces_before, n_tokens_before, n_edits and n_encoded (pre-tokens that were encoded again).

    counted: what count_tokens() returned, and, unless a function is given that makes edits of a text, a column
    edits: array<struct<start:long,end:long,new:string>> (places in code points; null or empty: none). Of overlapping
    edits the first applies; places beyond the text count as its end. No shuffle: join edits to counts as you like."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    names = ["doc_id", "text", "n_pieces", "n_tokens", "leaves"]
    fields = ", ".join(f"{n} {counted.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            given = b.column("edits") if edits is None else None
            for i in range(b.num_rows):
                text = b.column("text")[i].as_py()
                todo = edits(text or "") if given is None else [(e["start"], e["end"], e["new"] or "") for e in given[i].as_py() or ()]
                if not todo:
                    out.append((text, b.column("n_pieces")[i].as_py(), b.column("n_tokens")[i].as_py(), b.column("leaves")[i].as_py(), 0, 0))
                    continue
                leaves = [(x["chars"], x["pieces"], x["tokens"]) for x in b.column("leaves")[i].as_py()]
                tree = CountTree(text or "", counter(path), leaves, leaf)
                n = tree.edit(todo)
                out.append((tree.text, tree.totals[1], tree.totals[2], _as_rows(tree.leaves), n, tree.encoded))
            types = (pa.string(), pa.int64(), pa.int64(), _LEAF_TYPE, pa.int64(), pa.int64())
            before = [b.column("n_pieces"), b.column("n_tokens")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[j] for r in out], t) for j, t in enumerate(types)), *before], [*names, "n_edits", "n_encoded", "n_pieces_before", "n_tokens_before"])

    small_batches(counted.sparkSession)
    return ids_only(counted, (*names, *(["edits"] if edits is None else []))).mapInArrow(run, f"{fields}, n_edits long, n_encoded long, n_pieces_before long, n_tokens_before long")


def redactions(text: str) -> list[Edit]:
    """Edits that put the kind in brackets in place of personal data."""
    from . import pii

    global _anchors
    if _anchors is None:
        _anchors = pii.automaton()
    return [(s, e, f"[{k}]") for k, spans in pii.find(text, _anchors).items() for s, e in spans]


_anchors = None


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: tokens before and after its personal data is redacted, and what was encoded again for that."""
    before = count_tokens(read_table(spark, sf_dir, "documents"))
    after = recount_tokens(before, redactions)
    return after.select("doc_id", F.col("n_pieces_before").alias("n_pieces"), F.col("n_tokens_before").alias("n_tokens"), "n_edits", "n_encoded", F.col("n_tokens").alias("n_tokens_after"))
