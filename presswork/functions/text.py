"""Text expressions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunk size and carried overlap in characters, the shortest chunk
# that is kept is one longer than MIN_CHUNK_CHARS, sentence enders, tag pattern.
MAX_CHUNK_CHARS = 200
OVERLAP_CHARS = 30
MIN_CHUNK_CHARS = 10
# Sentences that are folded at a time; no fixed value.
BLOCK_SENTENCES = 64
SENTENCE_END = ".!?。"
TAG_PATTERN = "<[^>]+>"

# Every blank by Unicode's rule (Spark's own trim knows the space character only).
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_BLANK_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS) + "]"


def strip(text: Column) -> Column:
    """Drop leading and trailing blanks, Unicode ones and newlines included."""
    return F.btrim(text, F.lit(BLANKS))


def clean_html(text: Column) -> Column:
    """Text without tags and outer blanks; NULL becomes the empty string."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), TAG_PATTERN, ""))


def full_text(title: Column, description: Column) -> Column:
    """``title. description``, or the title alone when there is no description."""
    has_description = description.isNotNull() & (description != "")
    return F.when(has_description, F.concat(title, F.lit(". "), description)).otherwise(title)


def publisher(source_name: Column) -> Column:
    """Publisher part of ``publisher_section``."""
    return F.split_part(source_name, F.lit("_"), F.lit(1))


def sentences(text: Column) -> Column:
    """Split after a sentence end that is followed by blanks."""
    parts = F.split(strip(text), f"(?<=[{SENTENCE_END}]){_BLANK_CLASS}+")
    return F.filter(parts, lambda s: s != "")


def chunk_text(
    text: Column, max_len: int = MAX_CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> Column:
    """Array of sentence-aware chunks, as a fold over the sentence array.

    The fold runs over blocks of sentences, because the state is copied at each step: it
    holds the chunks of one block, and those of finished blocks are set aside.

    The state is (finished chunks, open chunk). A sentence longer than ``max_len``
    closes the open chunk and is cut into windows that overlap; one that does not
    fit starts a new open chunk led by the tail of the old one; any other is
    appended. The overlap lead may carry a chunk past ``max_len``.
    """
    blank_chunks = F.array().cast("array<string>")

    def state(done, open_chunk):
        return F.struct(done.alias("done"), open_chunk.alias("open"))

    def windows(sentence):
        starts = F.sequence(F.lit(1), F.length(sentence), F.lit(max_len - overlap))
        cut = F.transform(starts, lambda at: strip(sentence.substr(at, F.lit(max_len))))
        return F.filter(cut, lambda piece: piece != "")

    def close(acc):
        return F.when(acc["open"] == "", acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["open"]))
        )

    def lead(open_chunk, sentence):
        if overlap == 0:
            return sentence
        tail = F.ltrim(F.right(open_chunk, F.lit(overlap)), F.lit(BLANKS))
        return F.when(open_chunk == "", sentence).otherwise(
            F.when(tail == "", sentence).otherwise(F.concat(tail, F.lit(" "), sentence))
        )

    def add(acc, sentence):
        open_chunk = acc["open"]
        joined_length = F.length(open_chunk) + F.length(sentence) + 1
        return (
            F.when(
                F.length(sentence) > max_len,
                state(F.concat(close(acc), windows(sentence)), F.lit("")),
            )
            .when(joined_length > max_len, state(close(acc), lead(open_chunk, sentence)))
            .otherwise(
                state(
                    acc["done"],
                    F.when(open_chunk == "", sentence).otherwise(
                        F.concat(open_chunk, F.lit(" "), sentence)
                    ),
                )
            )
        )

    def add_block(acc, block):
        folded = F.aggregate(block, state(blank_chunks, acc["open"]), add)
        return F.transform(
            F.array(folded),
            lambda f: state(F.concat(acc["done"], F.array(f["done"])), f["open"]),
        )[0]

    def blocks(parts):
        last = F.greatest(F.ceil(F.size(parts) / BLOCK_SENTENCES).cast("int") - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda b: F.slice(parts, b * BLOCK_SENTENCES + 1, F.lit(BLOCK_SENTENCES)),
        )

    nothing = state(F.array().cast("array<array<string>>"), F.lit(""))

    def finish(acc):
        done = F.flatten(acc["done"])
        return F.when(acc["open"] == "", done).otherwise(F.concat(done, F.array(acc["open"])))

    # Bound once: the split would else be repeated for every block.
    return F.transform(
        F.array(sentences(text)), lambda parts: F.aggregate(blocks(parts), nothing, add_block, finish)
    )[0]
