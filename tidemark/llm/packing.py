"""Best-fit packing by linear grouping.

Documents become pieces of at most CAPACITY tokens. Only the histogram of lengths, which has CAPACITY entries at most,
is gathered. On it the plan is made: large lengths are sorted and cut into groups of equal cardinality, each rounded up
to its largest; configurations of these few sizes are chosen, largest first, each filled by a knapsack; actual lengths
take the places of the rounded ones; then small lengths go by best fit into the room that is left. Runs of equal
sequences are handled as one, so that the plan's size doesn't grow with the number of documents. A piece finds its place
by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import math
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_of_piece_char, tokenizer
from tidemark.llm.common import read, small_batches, written

CAPACITY = 4096
END_ID = 1
#: Lengths above CAPACITY / LARGE are large, and rounded up to GROUPS sizes.
LARGE, GROUPS = 4, 512
#: Bytes of words and ids that a task remembers, with what Python needs for an entry.
MEMO_BYTES, ENTRY_BYTES = 96_000_000, 200
BATCH_CHARS = 1_000_000
#: Fixed values of the tokenizer's file: how it splits, and the byte that stands for its end of a word here.
SPLIT, WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "\x01"
#: Unassigned (libraries differ in what they know), private or half a pair, and marks, whose order the normal form may change.
OWN_WAY = {"Cn", "Co", "Cs", "Mn", "Mc", "Me"}
BLOCK_PIECES = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long"


class Room:
    """Runs of sequences by the tokens that are free in each."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.free: list[int] = []

    def put(self, free: int, first: int, n: int) -> None:
        if n:
            if not self.runs[free]:
                insort(self.free, free)
            self.runs[free].append((first, n))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """A run of those with the least room that is enough."""
        i = bisect_left(self.free, length)
        if i == len(self.free):
            return None
        free = self.free[i]
        first, n = self.runs[free].pop()
        if not self.runs[free]:
            self.free.pop(i)
        return free, first, n


def configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Copies of each size: one of the largest that is left and what fills the rest best."""
    top = max(i for i, n in enumerate(left) if n)
    room = capacity - sizes[top]
    reach = np.full(room + 1, -1, np.int64)  # the item added last to reach this total, -2 for none yet
    reach[0] = -2
    for i in range(top, -1, -1):
        for _ in range(min(left[i] - (i == top), room // sizes[i])):
            new = np.flatnonzero((reach[sizes[i] :] == -1) & (reach[: room + 1 - sizes[i]] != -1)) + sizes[i]
            if not len(new):
                break
            reach[new] = i
    copies = [0] * len(sizes)
    copies[top] = 1
    at = int(np.flatnonzero(reach != -1)[-1])
    while at:
        i = int(reach[at])
        copies[i] += 1
        at -= sizes[i]
    return copies


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """length, rank (from which), n, sequence, offset, copies: pieces of ranks rank .. rank + n - 1 go, copies to a sequence, to the sequences from there on."""
    plan, used, room, n_sequences = [], defaultdict(int), Room(), 0

    def place(length: int, n: int, first: int, offset: int, copies: int) -> None:
        plan.append((length, used[length], n, first, offset, copies))
        used[length] += n

    large = sorted(x for x in histogram if x > capacity // LARGE)
    total = sum(histogram[x] for x in large)
    sizes, actual, in_group, most = [], [], 0, max(1, math.ceil(total / GROUPS))
    for x in reversed(large):
        n = histogram[x]
        while n:
            if not sizes or in_group == most:
                sizes.append(x)
                actual.append(deque())
                in_group = 0
            now = min(n, most - in_group)
            actual[-1].append([x, now])
            in_group += now
            n -= now
    sizes, actual = sizes[::-1], actual[::-1]
    left = [sum(n for _, n in x) for x in actual]
    while any(left):
        copies = configuration(sizes, left, capacity)
        times = min(left[i] // c for i, c in enumerate(copies) if c)
        slots = [i for i, c in enumerate(copies) for _ in range(c)][::-1]
        runs = [(n_sequences, times, 0)]
        for i in slots:
            left[i] -= times
            after = []
            for first, n, filled in runs:
                while n:
                    length, there = actual[i][0]
                    now = min(n, there)
                    place(length, now, first, filled, 1)
                    after.append((first, now, filled + length))
                    first, n = first + now, n - now
                    actual[i][0][1] -= now
                    if not actual[i][0][1]:
                        actual[i].popleft()
            runs = after
        for first, n, filled in runs:
            room.put(capacity - filled, first, n)
        n_sequences += times
    for length in sorted((x for x in histogram if x <= capacity // LARGE), reverse=True):
        n = histogram[length]
        while n:
            found = room.take(length)
            if found is None:
                found = capacity, n_sequences, math.ceil(n / (capacity // length))
                n_sequences += found[2]
            free, first, many = found
            copies = free // length
            whole = min(many, n // copies)
            if whole:
                place(length, whole * copies, first, capacity - free, copies)
                room.put(free - copies * length, first, whole)
                first, many, n = first + whole, many - whole, n - whole * copies
            if many and n and n < copies:
                place(length, n, first, capacity - free, n)
                room.put(free - n * length, first, 1)
                first, many, n = first + 1, many - 1, 0
            room.put(free, first, many)
    return pd.DataFrame(plan, columns=["length", "rank", "n", "sequence", "offset", "copies"]).astype("int64")


def library_ids(path: str, text: str) -> bytes:
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(2)
def word_encoder(path: str):
    """A function from words to the bytes of their ids, or None if the file isn't of the kind that it knows.

    It gives the ids of the file's own library at a fraction of the time: the merges are applied by a byte-level encoder,
    with WORD_END as the last byte of a word. That is the same where ids follow the order of the merges, as is checked here.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, kinds = found["model"], lambda x, k: [y["type"] for y in (x or {}).get(k, [])]
    vocab, merges = model.get("vocab", {}), [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    split = next((x for x in (found["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"), {})
    if model.get("end_of_word_suffix") != "</w>" or kinds(found["normalizer"], "normalizers") != ["NFC", "Replace", "Lowercase"] or kinds(found["pre_tokenizer"], "pretokenizers") != ["Split", "ByteLevel"]:
        return None
    if split.get("pattern") != {"Regex": SPLIT} or not split.get("invert") or any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(merges)):
        return None
    of = byte_of_piece_char()
    ranks = {bytes(of[c] for c in t.removesuffix("</w>")) + (WORD_END.encode() if t.endswith("</w>") else b""): i for t, i in vocab.items()}
    byte_level = tiktoken.Encoding("words", pat_str=f"[^{WORD_END}]*{WORD_END}", mergeable_ranks=ranks, special_tokens={})
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    pattern = regex.compile(SPLIT)

    def lower(w: str) -> str:
        """By character: only a sigma's lower case depends on its place otherwise."""
        return w.lower() if "Σ" not in w else "".join(map(str.lower, w))

    known: set[str] = set()  # characters that are in no category of OWN_WAY; at most all that there are

    def usual(w: str) -> bool:
        if not known.issuperset(w):
            known.update(c for c in set(w) if unicodedata.category(c) not in OWN_WAY)
        return known.issuperset(w)

    def encode(words: list[str]) -> list[bytes]:
        """Words with characters that one of both may not know, or that combine, are the library's."""
        odd = [not w.isascii() and not usual(w) for w in words]
        if any(odd):
            others = iter(encode([w for w, x in zip(words, odd, strict=True) if not x]))
            return [library_ids(path, w) if x else next(others) for w, x in zip(words, odd, strict=True)]
        parts = [pattern.findall(w.lower() if w.isascii() else lower(unicodedata.normalize("NFC", w))) for w in words]
        if not parts:
            return []
        ids = np.array(byte_level.encode_ordinary("".join(x + WORD_END for own in parts for x in own)), "<u4")
        last = np.flatnonzero(ends[ids]) + 1  # where each part ends
        at = last[np.cumsum([len(own) for own in parts]) - 1].tolist()
        data = ids.tobytes()
        return [data[4 * i : 4 * j] for i, j in zip([0, *at[:-1]], at, strict=True)]

    return encode


class WordIds(dict):
    """The bytes of the ids of words, as far as MEMO_BYTES go: of a task, and gone with it."""

    def __init__(self, encode):
        self.encode, self.size = encode, 0

    def learn(self, words: set[str]) -> None:
        """Afterwards all words are in it."""
        new = [w for w in words if w not in self]
        if self.size > MEMO_BYTES:
            self.clear()
            self.size, new = 0, list(words)
        self.update(zip(new, self.encode(new), strict=True))
        self.size += sum(ENTRY_BYTES + 2 * len(w) + len(self[w]) for w in new)


def pieces_of(path: str, capacity: int, special: list[str]):
    """Tokens of whole texts, cut. A word's ids are remembered; words never join across white space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fast = word_encoder(path)
        memo = WordIds(fast)
        # white space for split() that isn't the tokenizer's, and the byte that marks ends
        apart = ["\x1c", "\x1d", "\x1e", "\x1f", WORD_END, *special]
        end, block, n_block = np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId() << 32, 0

        def cut(part: list[tuple]) -> Iterator[tuple]:
            nonlocal block, n_block
            memo.learn({w for _, words, _ in part for w in words})
            for doc_id, words, text in part:
                ids = library_ids(path, text) if text is not None else b"".join(map(memo.__getitem__, words))
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    now = ids[at : at + 4 * capacity]
                    yield doc_id, piece, at // 4, len(now) // 4, zlib.crc32(now), block
                    n_block += 1
                if n_block >= BLOCK_PIECES:
                    block, n_block = block + 1, 0

        for batch in batches:
            part, chars, rows = [], 0, []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                text = text or ""
                odd = fast is None or any(x in text for x in apart)
                part.append((None if pd.isna(doc_id) else int(doc_id), [] if odd else text.split(), text if odd else None))
                chars += len(text)
                if chars > BATCH_CHARS:
                    rows += cut(part)
                    part, chars = [], 0
            rows += cut(part)
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "block"]).astype({"doc_id": "Int64"})

    return run


def placed(pieces: pd.DataFrame, before: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    """sequence_id and offset of a block's pieces. before: how many pieces of each length (its_length) the earlier blocks hold."""
    pieces = pieces.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
    length = pieces["length"].to_numpy()
    rank = pieces.groupby("length").cumcount().to_numpy() + before.set_index("its_length")["before"].reindex(length).to_numpy()
    key = plan["length"].to_numpy() * (1 << 44) + plan["rank"].to_numpy()
    at = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
    row = {c: plan[c].to_numpy()[at] for c in plan.columns}
    nth = rank - row["rank"]
    pieces["sequence_id"] = row["sequence"] + nth // row["copies"]
    pieces["offset"] = row["offset"] + nth % row["copies"] * length
    return pieces[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all rows of docs (doc_id, text) and their places in sequences of at most capacity tokens.

    Result per piece: doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long. A
    document is its tokens without added special ones, then END_ID; a null or empty text is END_ID alone. Only longer
    documents are cut. Null and repeated doc_id keep their rows. Other columns are ignored. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f)["added_tokens"]]
    pieces = written(docs.mapInPandas(pieces_of(path, capacity, special), PIECES), "pieces")
    counts = pieces.groupBy("block", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    plan = make_plan(histogram, capacity).sort_values(["length", "rank"], ignore_index=True)
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # under names of its own: both sides come from one table
    before = counts.select(F.col("block").alias("in_block"), F.col("length").alias("its_length"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    both = pieces.groupBy("block").cogroup(before.groupBy("in_block"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return both.applyInPandas(lambda a, b: placed(a, b, plan), schema)


def op8_pack_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
