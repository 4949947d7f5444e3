"""Exact token counts of byte-level BPE vocabularies, by merging ragged arrays.

Texts are cut into pre-tokens by the vocabulary's pattern. All pre-tokens of a batch that
are new to the task lie behind one another in one array of symbols, with a sequence number
for each. A round looks up the merge rank of every adjacent pair, finds the lowest rank of
each sequence and applies it everywhere in that sequence, in all sequences at once;
sequences without a pair to merge are counted and leave. A text's count is the sum over
its pre-tokens. Vocabulary files are read from a path the caller gives.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm.common import Memo, decoded, raw_texts

# Fixed values of byte-level BPE: the pattern, with white space as the library has it, and
# the code points that stand for themselves in the vocabulary.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = (
    r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^%(w)s\p{L}\p{N}]+|[%(w)s]+(?![^%(w)s])|[%(w)s]+"
    % {"w": WHITE}
)
VISIBLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]


def _narrow_pattern() -> str:
    """The pattern for texts of code points below 256, which the standard library cuts faster."""
    narrow = [chr(c) for c in range(256)]
    letters, digits = (
        "".join(re.escape(c) for c in narrow if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}")
    )
    spaces = "".join(re.escape(c) for c in narrow if re.match(f"[{WHITE}]", c))
    return PATTERN.replace(WHITE, spaces).replace(r"\p{L}+", f"[{letters}]+").replace(r"\p{N}+", f"[{digits}]+").replace(
        r"\p{L}\p{N}", letters + digits
    )


NEVER = np.iinfo(np.int32).max
_MEMO = 1 << 18
_MEMO_CHARS = 64
_STRETCH = 1 << 20
# Sequences beyond this many symbols are merged by a queue instead of rounds over all.
LONG = 1 << 14


_MASK = (1 << 19) - 1


def pair_slot(keys: np.ndarray) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(45)).astype(np.int64)


def spread_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open-addressing table of pair keys and their ranks; unused places hold -1."""
    if len(keys) > _MASK // 2:
        raise ValueError("more merges than the lookup table has room for")
    table, ranks = np.full(_MASK + 1, -1, np.int64), np.zeros(_MASK + 1, np.int32)
    for rank, (key, at) in enumerate(zip(keys.tolist(), pair_slot(keys).tolist())):
        while table[at] != -1:
            at = (at + 1) & _MASK
        table[at], ranks[at] = key, rank
    return table, ranks


def pair_ranks(table: np.ndarray, ranks: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks of pair keys in a table of ``spread_pairs``; ``NEVER`` for keys not in it."""
    at = pair_slot(key)
    out = np.full(len(key), NEVER, np.int32)
    open_ = np.arange(len(key))
    while len(open_):
        found = table[at]
        hit = found == key
        out[open_[hit]] = ranks[at[hit]]
        go_on = ~hit & (found != -1)
        open_, key, at = open_[go_on], key[go_on], (at[go_on] + 1) & _MASK
    return out


class ByteBpe:
    """A byte-level BPE vocabulary of the ``tokenizers`` library, for counting only."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE"
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and not model.get("ignore_merges")
            and not any(
                t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]
            )
        )
        if not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        visible = [b for lo, hi in VISIBLE for b in range(lo, hi + 1)]
        hidden = [b for b in range(256) if b not in set(visible)]
        symbol = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.first = np.array([vocab[symbol[b]] for b in range(256)], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.keys, self.ranks = spread_pairs(keys)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.narrow = re.compile(_narrow_pattern())
        self.memo = Memo(_MEMO, _MEMO_CHARS)
        self.gap = regex.compile(f"(?<=[^{WHITE}])[{WHITE}]")

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, or ``NEVER``."""
        return pair_ranks(self.keys, self.ranks, left * self.size + right)

    def count_pre_tokens(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        counts = np.zeros(len(pre_tokens), np.int64)
        short = [i for i, p in enumerate(pre_tokens) if len(p) <= LONG]
        for i, p in enumerate(pre_tokens):
            if len(p) > LONG:
                counts[i] = self._count_long(p)
        flat = self.first[np.frombuffer(b"".join(pre_tokens[i] for i in short), np.uint8)]
        lengths = np.array([len(pre_tokens[i]) for i in short], np.int64)
        row = np.repeat(np.array(short, np.int64), lengths)

        def ranks(at: np.ndarray) -> np.ndarray:
            """Ranks of the pairs that begin at places, none at the end of a sequence."""
            after = np.minimum(at + 1, len(flat) - 1)
            out = pair_ranks(self.keys, self.ranks, flat[at] * self.size + flat[after])
            out[(row[after] != row[at]) | (after == at)] = NEVER
            return out

        rank = ranks(np.arange(len(flat)))
        while len(flat):
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            size = np.diff(np.concatenate((starts, [len(row)])))
            least = np.minimum.reduceat(rank, starts)
            done = least == NEVER
            counts[row[starts[done]]] = size[done]
            least = np.repeat(least, size)
            stay = least != NEVER
            # Of overlapping hits (a a a) every second one is applied, from the left.
            place = np.flatnonzero((rank == least) & stay)
            if len(place):
                new_run = np.concatenate(([True], np.diff(place) != 1))
                run_start = place[new_run][np.cumsum(new_run) - 1]
                place = place[(place - run_start) % 2 == 0]
                flat[place] = self.made[rank[place]]
                stay[place + 1] = False
            place = (np.cumsum(stay) - 1)[place]
            flat, row, rank = flat[stay], row[stay], rank[stay]
            changed = np.concatenate((place, place[place > 0] - 1))
            rank[changed] = ranks(changed)
        return counts

    @functools.cached_property
    def _rank_of(self) -> dict[int, int]:
        used = self.keys != -1
        return dict(zip(self.keys[used].tolist(), self.ranks[used].tolist()))

    def _count_long(self, pre_token: bytes) -> int:
        """The same merges for one very long pre-token, lowest rank first by a queue."""
        ids = self.first[np.frombuffer(pre_token, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank_of = self._rank_of
        made, size, alive = self.made.tolist(), self.size, len(ids)
        queue = [
            (r, i, ids[i], ids[i + 1])
            for i in range(len(ids) - 1)
            if (r := rank_of.get(ids[i] * size + ids[i + 1])) is not None
        ]
        heapq.heapify(queue)
        while queue:
            r, i, left, right = heapq.heappop(queue)
            j = after[i] if ids[i] == left else len(ids)
            if j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = made[r], -1
            alive -= 1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else len(ids)
                if b < len(ids) and (s := rank_of.get(ids[a] * size + ids[b])) is not None:
                    heapq.heappush(queue, (s, a, ids[a], ids[b]))
        return alive

    def _stretches(self, text: str) -> Iterator[str | None]:
        """Parts of a text that can be cut into pre-tokens alone; None for an added token."""
        at = 0
        while at < len(text):
            found = self.special.search(text, at) if self.special else None
            end = found.start() if found else len(text)
            while end - at > _STRETCH:
                gap = self.gap.search(text, at + _STRETCH, end)
                if gap is None:
                    break
                yield text[at : gap.start()]
                at = gap.start()
            if at < end:
                yield text[at:end]
            if found:
                yield None
            at = found.end() if found else len(text)

    def _cut(self, stretch: str) -> list[str]:
        try:
            stretch.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(stretch)
        return self.narrow.findall(stretch)

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; pre-tokens are remembered, up to a bounded number."""
        totals = [0] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def settle():
            nonlocal held
            wanted = set().union(*(found for _, found in waiting))
            memo = self.memo.fill(wanted, self._counts)
            for i, found in waiting:
                totals[i] += sum(map(memo.__getitem__, found))
            waiting.clear()
            held = 0

        for i, text in enumerate(texts):
            for stretch in self._stretches(text):
                if stretch is None:
                    totals[i] += 1
                    continue
                waiting.append((i, self._cut(stretch)))
                held += len(stretch)
                if held > _STRETCH:
                    settle()
        settle()
        return totals

    def _counts(self, pre_tokens: list[str]) -> list[int]:
        return self.count_pre_tokens([p.encode() for p in pre_tokens]).tolist()


@functools.lru_cache(maxsize=2)
def vocabulary_of(path: str) -> ByteBpe:
    """The vocabulary of a path, read once in a worker, with what it has counted."""
    return ByteBpe(path)


def with_token_counts(
    docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens"
) -> DataFrame:
    """``docs`` with n_bytes (UTF-8) and ``out`` added, the exact token count of each text.

    Null texts count as empty. No begin, end or added special tokens; special strings in a
    text are one token each, as the library counts by default. ``vocabulary`` is a path
    that every executor can read.
    """
    rest = docs.drop("n_bytes", out)
    at = rest.columns.index(text)

    def run(batches):
        bpe = vocabulary_of(vocabulary)
        for batch in batches:
            raw = [t or b"" for t in raw_texts(batch.column(at))]
            counts = bpe.count_texts([decoded(t) for t in raw])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(map(len, raw), pa.int64()), pa.array(counts, pa.int64())],
                [*batch.schema.names, "n_bytes", out],
            )

    fields = [T.StructField(n, T.LongType()) for n in ("n_bytes", out)]
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *fields]))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    counted = with_token_counts(docs.select("doc_id", "text"), vocabulary)
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
