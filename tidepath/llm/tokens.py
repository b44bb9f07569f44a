"""Byte-level BPE ids by Spark expressions: words fold ranked merges over their bytes with literal rank tables.

A text is cut in words by the tokenizer's pattern. A word that is itself a token has its rank as id. Any other
word is folded: its state is a string with one character per piece, at first one per byte, and each step replaces
the neighbouring pair of lowest rank, wherever it stands, by the character of the joined piece. Replacing is one
native call, so a step costs one look-up for each pair left and little else.

Tables are literals of two slots a key (cuckoo hashing on the 64-bit hash): a look-up is at most two comparisons.
Functions that scan (`array_position`, look-ups in maps, slices) are avoided on purpose: inside a higher-order function
each costs as much as ten such look-ups.
"""

from __future__ import annotations

import base64
import functools
import json

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepath.llm import TOKENIZERS
from tidepath.sources.tables import spread

# fixed values of the public pattern, with Unicode white space spelled for Java
WORDS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: The same for regex engines that know `\s` as Unicode white space.
PATTERN = WORDS.replace(r"\p{IsWhite_Space}", r"\s").replace(r"\P{IsWhite_Space}", r"\S")
PLACE = 31  # bits that hold a pair's place in its word, below its rank
DONE = "￿"  # stands behind a state that no pair can shorten
TABLES = "words array<string>, word_ids array<int>, pairs array<string>, pair_ids array<int>, chars array<string>, bytes array<int>"


def ranks(path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """Token bytes and ids of a rank file; the vocabulary's size bounds everything made of it."""
    with open(f"{path}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _hash_table(entries: dict[str, int]) -> tuple[list[str | None], list[int | None]]:
    """Keys and values in slots, each key in one of the two its hash names."""
    n = 1 << (len(entries) * 2).bit_length()
    slots = lambda k: ((h := xxhash.xxh64_intdigest(k.encode(), seed=42)) & (n - 1), (h >> 32) & (n - 1))  # noqa: E731  as the SQL function xxhash64
    keys: list[str | None] = [None] * n
    values: list[int | None] = [None] * n
    for key, value in entries.items():
        k, v, at = key, value, slots(key)[0]
        for _ in range(10_000):
            k, keys[at] = keys[at], k
            v, values[at] = values[at], v
            if k is None:
                break
            one, two = slots(k)
            at = two if at == one else one
        else:
            raise ValueError(f"no free slot for {key!r} among {n}")
    return keys, values


@functools.lru_cache(maxsize=4)
def _tables(path: str, name: str) -> tuple[str, int, int]:
    """The tables as JSON, and the slots of the words and of the pairs."""
    known = ranks(path, name)
    byte = {known[bytes([i])]: chr(i) for i in range(256)}
    char = lambda i: byte.get(i) or chr(256 + i)
    if 256 + max(known.values()) >= 0xD800:
        raise ValueError("the vocabulary is larger than the characters that can stand for its pieces")
    words, pairs = {}, {}
    for token, rank in known.items():
        try:
            words[token.decode()] = rank
        except UnicodeDecodeError:  # no word of a text
            pass
        for i in range(1, len(token)):
            a, b = known.get(token[:i]), known.get(token[i:])
            if a is not None and b is not None:
                pairs[char(a) + char(b)] = rank
    chars: list[str | None] = [None] * (max(known.values()) + 1)
    for i in known.values():
        chars[i] = char(i)
    wk, wi = _hash_table(words)
    pk, pi = _hash_table(pairs)
    text = json.dumps({"words": wk, "word_ids": wi, "pairs": pk, "pair_ids": pi, "chars": chars, "bytes": [known[bytes([i])] for i in range(256)]}, separators=(",", ":"))
    return text, len(wk), len(pk)


def rank_tables(path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Column:
    """The literal: a struct of TABLES, folded to a constant when the plan is optimised."""
    return F.from_json(F.lit(_tables(path, name)[0]), TABLES)


def bind(value: Column, body) -> Column:
    """body(value) with a large value evaluated once and not copied."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with a small value computed once; an aggregate's end costs less than an array around the value."""
    return F.aggregate(F.array(F.lit(0)), value, lambda a, _: a, body)


def rank_of(keys: Column, values: Column, slots: int, s: Column) -> Column:
    """Value of a key in a table of two slots a key, NULL if it has none."""

    def look(h: Column) -> Column:
        one, two = h.bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(slots - 1))
        return F.when(F.get(keys, one) == s, F.get(values, one)).when(F.get(keys, two) == s, F.get(values, two))

    return let(F.xxhash64(s), look)


def merge(table: Column, slots: int, word: Column) -> Column:
    """Ids of a word of at least two bytes that is no token, held as one character (U+0000 to U+00FF) per byte.

    A pair's rank and, below it, its place make one number, so the least number names the leftmost pair of lowest rank.
    All places of that pair are joined in one step, left to right, as joining them one by one would. The steps left
    after the last join find DONE and cost next to nothing."""

    def step(s: Column, _: Column) -> Column:
        def join(best: Column) -> Column:
            pair = F.substring(s, best.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"), F.lit(2))
            return F.when(best.isNull(), F.concat(s, F.lit(DONE))).otherwise(F.replace(s, pair, F.get(table["chars"], F.shiftright(best, PLACE))))

        placed = lambda i: let(F.substring(s, i, F.lit(2)), lambda p: F.shiftleft(rank_of(table["pairs"], table["pair_ids"], slots, p).cast("long"), PLACE).bitwiseOR(i.cast("long")))
        return F.when(F.endswith(s, F.lit(DONE)), s).otherwise(let(F.array_min(F.transform(F.sequence(F.lit(1), F.length(s) - 1), placed)), join))

    id_of = lambda c: let(F.ascii(c), lambda a: F.when(a < 256, F.get(table["bytes"], a)).otherwise(a - 256))
    return F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), word, step, lambda s: F.transform(F.split(F.replace(s, F.lit(DONE), F.lit("")), ""), id_of))


def encode(text: Column, path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Column:
    """array<int> of a text's ids, without special tokens: strings that look like them are ordinary text. NULL and
    empty texts give an empty array. The whole text is encoded, however long; a single word without white space
    or change between letters, digits and signs costs its length times its distinct joins."""
    _, of_words, of_pairs = _tables(path, name)
    bytes_of = lambda w: F.when(F.length(w) == F.octet_length(w), w).otherwise(F.decode(F.encode(w, "UTF-8"), "ISO-8859-1"))

    def ids(table: Column) -> Column:
        def word(w: Column) -> Column:
            return let(rank_of(table["words"], table["word_ids"], of_words, w), lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(let(bytes_of(w), lambda s: merge(table, of_pairs, s))))

        return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0)), word))

    # the literal stands once in the plan, not at each look-up
    return bind(rank_tables(path, name), ids)


def encode_documents(documents: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, ids), one row per row of documents, repeated ids included. Other columns are ignored; an empty
    table gives no rows. Rows are encoded where they are read; only a table of fewer splits than cores is spread
    over them first."""
    return spread(documents.select(id_column, text)).select(id_column, encode(F.col(text), path, name).alias("ids"))


def decode_ids(ids: Column, path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Column:
    """The text of ids: their tokens' binary pieces concatenated, then read as UTF-8. Unknown ids give NULL."""
    size = max(ranks(path, name).values()) + 1
    pieces: list[str | None] = [None] * size
    for token, rank in ranks(path, name).items():
        pieces[rank] = base64.b64encode(token).decode()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<binary>")
    return F.decode(F.aggregate(ids, F.lit(b""), lambda a, i: F.concat(a, F.get(table, i))), "UTF-8")
