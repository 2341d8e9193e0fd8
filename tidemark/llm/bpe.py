"""BPE encoding and decoding through a table of distinct words.

1. Texts are split into words, in blocks of whole documents of one input partition. A block lists each of its words
   once, and keeps the number of the word at each position of its documents.
2. The lists meet in groups by a hash of the word. There each distinct word is encoded once.
3. The ids go back to the blocks that list the word. Each word's ids are joined with the id-to-piece table, whose pieces
   decode it; by position, ids and decoded words make up the documents again.

A word here is a stretch of text that the tokenizer's own splitting never joins with its neighbours: a run of white space
with the run of other characters after it. Special tokens are words of their own. What is shuffled is packed: a list of
words in alphabetic order, ids in that order, positions by frequency of the word. Blocks are made twice, from the same
partitions: once for the lists, once for the positions.

Ids are joined with their pieces in the tasks that have them, not as rows: rows of (word, position, id) for a join by
Spark were tried, and took three times the input on disk.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, small_batches

#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 16_000_000
#: Groups of the word table for each input partition; a group holds about as many words at every size of the input.
GROUPS_PER_PARTITION = 8
#: White space as the tokenizer sees it: without the four separators that Python's \s has besides.
CHUNKS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def special_tokens(path: str) -> list[str]:
    return [x.content for _, x in sorted(tokenizer(path).get_added_tokens_decoder().items())]


def words_of(text: str, special: re.Pattern | None) -> list[str]:
    """The words of a text, which joined are the text."""
    if special is not None and special.search(text):
        return [w for i, part in enumerate(special.split(text)) if part for w in ([part] if i % 2 else words_of(part, None))]
    plain, words = text.count(" ") + text.count("\n"), text.split()
    # no other white space, as only so many characters are not in words; and each has a word on both sides
    if len(words) == plain + 1 and sum(map(len, words)) + plain == len(text) and "\0" not in text:
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
    return CHUNKS.findall(text)


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def planes(values: np.ndarray) -> bytes:
    """int32 values byte by byte: first all low bytes, and so on, which packs better."""
    return values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


LISTS = "block long, group_no int, data binary"
POSITIONS = "block long, doc_ids array<long>, lengths array<int>, data binary, places binary, words_crc long"


def in_order(numbers: Numbers, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's words, the crc32 of each, and their numbers in order of (group, word): an order that only depends on the set."""
    words = object_array(list(numbers))
    crc = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
    listed = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
    return words, crc, listed[np.argsort(crc[listed] % n_groups, kind="stable")]


def lists_of(block: int, docs: list[tuple], numbers: Numbers, n_groups: int) -> Iterator[tuple]:
    """For each group the block's words of that group."""
    words, crc, listed = in_order(numbers, n_groups)
    group = crc[listed] % n_groups
    for own in np.split(listed, np.flatnonzero(np.diff(group)) + 1) if len(listed) else []:
        yield block, int(crc[own[0]] % n_groups), pack(word_list(words[own]))


def positions_of(block: int, docs: list[tuple], numbers: Numbers, n_groups: int) -> Iterator[tuple]:
    """The words at all positions, by their rank in frequency, and the place of each rank in the order of (group, word)."""
    words, crc, listed = in_order(numbers, n_groups)
    flat = np.concatenate([x for _, x in docs])
    by_count = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    rank, place = np.empty(len(words), np.int32), np.empty(len(words), np.int32)
    rank[by_count] = place[listed] = np.arange(len(words))
    yield block, [x for x, _ in docs], [len(x) for _, x in docs], pack(planes(rank[flat])), pack(planes(place[by_count])), int(crc.sum())


def word_list(words) -> bytes:
    sizes = np.fromiter((len(w.encode()) for w in words), "<u4", len(words))
    return len(words).to_bytes(8, "little") + sizes.tobytes() + "".join(words).encode()


def from_word_list(data: bytes) -> list[str]:
    n = int.from_bytes(data[:8], "little")
    at = 8 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n, 8), dtype=np.int64)])
    return [data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def split_blocks(special: list[str], n_groups: int, rows_of, columns: list[str]):
    """rows_of over the blocks of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        block, chars, numbers, docs = TaskContext.get().partitionId() << 32, 0, Numbers(), []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                words = words_of(text or "", pattern)
                docs.append((None if pd.isna(doc_id) else int(doc_id), np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    yield pd.DataFrame(rows_of(block, docs, numbers, n_groups), columns=columns)
                    block, chars, numbers, docs = block + 1, 0, Numbers(), []
        if docs:
            yield pd.DataFrame(rows_of(block, docs, numbers, n_groups), columns=columns)

    return run


def encode_group(path: str):
    """Of a group's lists each distinct word is encoded once; a list's ids stand in the order of its words."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        numbers = Numbers()
        at = [np.fromiter(map(numbers.__getitem__, words := from_word_list(unpack(x))), np.int64, len(words)) for x in lists["data"]]
        found = [x.ids for x in tokenizer(path).encode_batch(list(numbers), add_special_tokens=False)]
        ids = object_array([np.array(x, "<i4") for x in found])
        size = np.fromiter(map(len, found), "<i4", len(found))
        packed = [pack(len(x).to_bytes(8, "little") + size[x].tobytes() + b"".join(y.tobytes() for y in ids[x])) for x in at]
        crc = np.fromiter((zlib.crc32(w.encode()) for w in numbers), np.int64, len(numbers))
        return pd.DataFrame({"in_block": lists["block"], "group_no": lists["group_no"], "ids": packed, "list_crc": [int(crc[x].sum()) for x in at]})

    return run


def byte_of_piece_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, all other bytes for 256 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(path: str) -> list[bytes]:
    """The id-to-piece table; the tokenizer's file fixes its size."""
    of, own = byte_of_piece_char(), tokenizer(path)
    special = {x.content for x in own.get_added_tokens_decoder().values()}
    table = {i: p.encode() if p in special else bytes(of[c] for c in p) for p, i in own.get_vocab(with_added_tokens=True).items()}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def words_back(block: pd.DataFrame, lists: pd.DataFrame, table: np.ndarray) -> tuple[list[np.ndarray], list[str]]:
    """Ids and decoded text of a block's words, in the order of (group, word)."""
    if block["words_crc"].sum() != lists["list_crc"].sum():
        raise ValueError("the documents were not the same when they were read again; write them to a table first")
    ids: list[np.ndarray] = []
    for data in lists.sort_values("group_no")["ids"]:
        data = unpack(data)
        n = int.from_bytes(data[:8], "little")
        size = np.frombuffer(data, "<i4", n, 8)
        ids += np.split(np.frombuffer(data, "<i4", offset=8 + 4 * n), np.cumsum(size)[:-1]) if n else []
    return ids, [b"".join(table[x].tolist()).decode("utf-8", "replace") for x in ids]


def documents_back(block: pd.DataFrame) -> Iterator[tuple]:
    """doc_id and the places of its words in the block's list."""
    for row in block.itertuples():
        at = from_planes(unpack(row.places))[from_planes(unpack(row.data))]
        ends = np.cumsum(row.lengths)
        yield from zip([None if pd.isna(x) else int(x) for x in row.doc_ids], np.split(at, ends[:-1]), strict=True)


def object_array(items: list) -> np.ndarray:
    out = np.empty(len(items), dtype=object)
    out[:] = items
    return out


def digested(block: pd.DataFrame, lists: pd.DataFrame, table: np.ndarray) -> pd.DataFrame:
    ids, decoded = words_back(block, lists, table)
    as_text, size = object_array([",".join(map(str, x.tolist())) for x in ids]), np.fromiter(map(len, ids), np.int64, len(ids))
    whole, sha = object_array(decoded), lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = [(doc_id, int(size[at].sum()), sha(",".join(as_text[at].tolist())), sha("".join(whole[at].tolist()))) for doc_id, at in documents_back(block)]
    return pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})


def in_full(block: pd.DataFrame, lists: pd.DataFrame, table: np.ndarray) -> pd.DataFrame:
    ids, decoded = words_back(block, lists, table)
    whole = object_array(decoded)
    out = [(doc_id, np.concatenate([np.zeros(0, "<i4"), *[ids[i] for i in at.tolist()]]), "".join(whole[at].tolist())) for doc_id, at in documents_back(block)]
    return pd.DataFrame(out, columns=["doc_id", "ids", "decoded"]).astype({"doc_id": "Int64"})


def by_block(docs: DataFrame, path: str, fn, schema: str) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    n_groups = GROUPS_PER_PARTITION * max(1, docs.rdd.getNumPartitions())
    split = lambda rows_of, schema: docs.mapInPandas(split_blocks(special_tokens(path), n_groups, rows_of, [x.split()[0] for x in schema.split(", ")]), schema)
    encoded = split(lists_of, LISTS).groupBy("group_no").applyInPandas(encode_group(path), "in_block long, group_no int, ids binary, list_crc long")
    table = pieces(path)
    both = split(positions_of, POSITIONS).groupBy("block").cogroup(encoded.groupBy("in_block"))
    return both.applyInPandas(lambda a, b: fn(a, b, object_array(table)), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id long, ids array<int>, decoded string, of every row of docs (doc_id, text).

    ids are those of the tokenizer in the file at path, without added special tokens; a special token's own string in a
    text is that token. A null text counts as empty and has no ids. Null and repeated doc_id keep their rows. Whole
    texts are taken, of any length; no rows give no rows. Other columns are ignored. docs is read twice, which takes less disk than a table of
    the positions; if its partitions differ the second time, the job fails and says so.
    """
    return by_block(docs, path, in_full, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() with its long columns digested where they are made."""
    return by_block(docs, path, digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
