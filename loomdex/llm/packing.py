"""Hierarchical packing of token ids into sequences of several context sizes.

Each text becomes ids and an end id. Tiers are context sizes, powers of two. A document first
gives away windows of the longest tier, which it fills alone; what remains of it is routed to
the shortest tier that holds it. In each tier, longest first, such remainders open windows, and
what a window lacks is filled from shorter tiers: by the longest that fits, again and again, and
where none fits by the head of the longest, whose rest goes back to its tier. Windows for which
shorter tiers have nothing left are put one behind the other and cut at the tiers' sizes.

Packing runs where ids are made: a task packs GROUP_TOKENS or a little more at a time and hands
what is less than the shortest tier on to its next group, so texts and ids are never shuffled
and the padding doesn't depend on how rows are dealt. A task's last tokens, fewer than the shortest tier's,
become sequences of lower powers of two. So no sequence has padding, and a task makes at most as
many short ones as its shortest tier has bits. Sequences are numbered by task and place in it: a task that runs
again gives the same, while other splits of the input give other sequences.

Step groups: the sequences of each tier, in a seeded order over the whole table, are spread evenly over
as many groups as the tokens ask for, so that all groups have the same mix of lengths, and their
tokens differ by less than one sequence of each length.

Encoding. White space never belongs to a token and nothing of the tokenizer reaches over it, so
texts are cut at ASCII white space, and between a letter and a stop, where a token ends too; each distinct
part is encoded once by the tokenizers library. A worker remembers MEMO parts and then begins anew. A
part without any such place is encoded whole, however long.

A task holds one group's ids, the largest text's among them, its memo and the tokenizer file,
which the driver reads and broadcasts: 1.7 MB whatever the input. Null and empty texts have the
end id alone. Rows with equal or null doc_id are packed each for itself. Documents of equal
length are taken in the order of rows. An empty table gives an empty one. Only the named columns
come out, so others can't clash.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import small_batches, stored
from loomdex.llm.mixing import ranked
from loomdex.llm.pieces import portions

TOKENIZER, END = "/opt/tokenizers/word_bpe_49k.json", 2
TIERS = (4096, 2048, 1024, 512, 256)
GROUP_TOKENS, STEP_TOKENS, MEMO, PORTION, SEED = 1 << 18, 1 << 18, 1 << 19, 4096, 42

#: Marks before which a token ends, if a letter stands there; an apostrophe isn't one, as it can begin a token with letters.
STOPS = b".,;:!?#$%&*()\""
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]], _STOP[list(STOPS)] = True, True

#: A run of an item's tokens: (item, start, length).
Run = tuple[int, int, int]


def plan(items: Sequence[Run], tiers: Sequence[int] = TIERS, last: bool = True) -> tuple[list[list[Run]], list[Run]]:
    """Sequences, each a list of runs, and what is left, less than the shortest tier; with last, nothing is."""
    longest, made = tiers[0], []
    short: list[tuple[int, int, int]] = []  # (length, item, start), sorted
    for item, at, n in items:
        while n >= longest:
            made.append([(item, at, longest)])
            at, n = at + longest, n - longest
        if n:
            short.append((n, item, at))
    short.sort()
    rest: deque[Run] = deque()
    for tier, next_ in zip(tiers, [*tiers[1:], 0], strict=True):
        while short and short[-1][0] > next_:
            n, item, at = short.pop()
            window, gap = [(item, at, n)], tier - n
            while gap:
                # what fits, of this tier or a shorter one, or else of a shorter one what has to be cut
                end = bisect_right(short, (gap, float("inf"))) or bisect_right(short, (next_ or tier, float("inf")))
                if not end:
                    break
                n, item, at = short.pop(end - 1)
                took = min(n, gap)
                window.append((item, at, took))
                gap -= took
                if took < n:
                    insort(short, (n - took, item, at + took))
            if gap:
                rest.extend(window)
            else:
                made.append(window)
    left = sum(n for _, _, n in rest)
    sizes = list(tiers)
    while last and sizes[-1] > 1:
        sizes.append(sizes[-1] // 2)
    for size in sizes:
        while left >= size:
            made.append(_taken(rest, size))
            left -= size
    return made, list(rest)


def _taken(rest: deque[Run], size: int) -> list[Run]:
    """The first tokens of a queue of runs."""
    out = []
    while size:
        item, at, n = rest.popleft()
        if n > size:
            rest.appendleft((item, at + size, n - size))
            n = size
        out.append((item, at, n))
        size -= n
    return out


def _parts(texts: Sequence[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The parts of all texts that are encoded by themselves, and how many each text has.

    Letters of ASCII become small ones, as in the tokenizer, unless a special token could come of that, and a
    blank goes between such a letter and a mark of STOPS, where a token always ends.
    """
    split = []
    for t in texts:
        t = t or b""
        if b"<|" not in t:
            t = t.lower()
        raw = np.frombuffer(t, np.uint8)
        at = np.flatnonzero(_LETTER[raw[:-1]] & _STOP[raw[1:]]) + 1
        split.append((np.insert(raw, at, 32).tobytes() if len(at) else t).split())
    return list(chain.from_iterable(split)), np.fromiter(map(len, split), np.int64, len(split))


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each part of texts once."""

    def __init__(self, model: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_str(model), memo
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.sizes, self.at = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        ids, sizes = [self.ids], [self.sizes]
        for at in range(0, len(new), PORTION):
            some = new[at : at + PORTION]
            others = [p.decode() for p in some if not (p.isalpha() and p.islower())]
            encoded = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else [])
            # small letters of ASCII are what the model itself is given for them
            found = [[x.id for x in self.tokenizer.model.tokenize(p.decode())] if p.isalpha() and p.islower() else next(encoded).ids for p in some]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.at = np.cumsum(self.sizes) - self.sizes

    def __call__(self, texts: Sequence[bytes | None]) -> list[np.ndarray]:
        parts, counts = _parts(texts)
        if not parts:
            return [np.zeros(0, np.uint32) for _ in texts]
        if len(self.number) > self.memo:
            self._forget()
        of = np.fromiter(map(self.number.get, parts, repeat(-1)), np.int64, len(parts))
        if len(lacking := np.flatnonzero(of < 0)):
            some = [parts[k] for k in lacking.tolist()]
            self._learn(list(dict.fromkeys(some)))
            of[lacking] = [self.number[p] for p in some]
        n = self.sizes[of]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[of] - (ends - n), n) + np.arange(ends[-1])]
        return np.split(ids, np.append(0, ends)[np.cumsum(counts)][:-1])


_encoders: dict[int, Encoder] = {}


def encoder(model: str) -> Encoder:
    """A worker's encoder; it serves the tasks that follow too."""
    key = hash(model)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = TOKENIZER, end: int = END, tiers: Sequence[int] = TIERS, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier[, ids]) of each piece, written to shared storage.

    tier is the length of the sequence, offset the place in it, ids_crc32 the checksum of the
    piece's ids as little-endian 32-bit integers.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True) or tiers[-1] < 1:
        raise ValueError("tiers must be falling powers of two")
    spark = docs.sparkSession
    small_batches(spark)
    with open(model, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier"]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in names), *([T.StructField("ids", T.ArrayType(T.LongType(), False))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(shared.value), TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # (id, ids from a place on, that place, ids of the document)
        tokens = sequences = 0
        id_type = None

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, tokens, sequences
            made, rest = plan([(k, 0, len(ids)) for k, (_, ids, _, _) in enumerate(held)], tiers, last)
            cols: list[list] = [[] for _ in range(9)]
            for runs in made:
                offset, size = 0, sum(n for _, _, n in runs)
                for k, at, n in runs:
                    id_, ids, before, total = held[k]
                    raw = ids[at : at + n].astype("<u4")
                    for c, v in zip(cols, (id_, before + at, n, zlib.crc32(raw.tobytes()), total, task + sequences, offset, size, raw if with_ids else None), strict=True):
                        c.append(v)
                    offset += n
                sequences += 1
            held = [(held[k][0], held[k][1][at : at + n].copy(), held[k][2] + at, held[k][3]) for k, at, n in rest]
            tokens = sum(len(x[1]) for x in held)
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:8])]
            if with_ids:
                edges = np.concatenate([[0], np.cumsum(cols[2])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.zeros(0), *cols[8]]).astype(np.int64))))
            return pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

        for b in batches:
            id_type = b.schema.field(0).type
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for part in portions(texts):
                for id_, ids in zip(doc_ids[part], encode(texts[part]), strict=True):
                    ids = np.append(ids, np.uint32(end))
                    held.append((id_, ids, 0, len(ids)))
                    tokens += len(ids)
                if tokens >= group_tokens:
                    yield flush(False)
        if held:
            yield flush(True)

    return stored(rows.mapInArrow(run, schema))


def with_step_groups(pieces: DataFrame, step_tokens: int = STEP_TOKENS, seed: int = SEED) -> DataFrame:
    """pieces with step_group, from 0: groups of about so many tokens, with the same mix of tiers in each."""
    heads = pieces.where("offset = 0").select("sequence_id", "tier")  # one row a sequence
    order = ranked(heads, F.desc("tier"), F.xxhash64(F.lit(seed), "sequence_id"), F.col("sequence_id"), out="rank")
    tiers = order.groupBy("tier").agg(F.min("rank").alias("first"), F.count("*").alias("n"))  # a row a power of two
    steps = F.greatest(F.ceil(F.sum(F.col("tier") * F.col("n")) / step_tokens), F.lit(1)).cast("long")
    tiers = tiers.crossJoin(F.broadcast(tiers.agg(steps.alias("steps"))))
    placed = order.join(F.broadcast(tiers), "tier").select("sequence_id", F.expr("((rank - first) * steps) div n").alias("step_group"))
    return pieces.join(placed, "sequence_id")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths) of packed sequences, from pieces with ids; a sequence has as many pieces as tokens at most."""
    part = F.struct("offset", "doc_id", "length", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    of = lambda c: F.transform("p", lambda x: x[c])
    return whole.select("sequence_id", F.flatten(of("ids")).alias("ids"), of("doc_id").alias("doc_ids"), of("length").alias("lengths"))
