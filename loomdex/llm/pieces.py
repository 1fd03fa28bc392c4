"""SentencePiece encoding and decoding by a relational lattice.

Encoding. Texts are cut where no piece of the model can cross: the model's pieces hold a known
set of character pairs, and between any other pair no merge or path can run, so the parts,
called words here, are independent and exact. The distinct words of the corpus are counted,
their substrings up to the longest piece are exploded and equi-joined to the piece table (a
fixed table, broadcast), the matches are grouped by word into its lattice, and a fold with
Spark's aggregate() picks the path. The result is a dictionary from words to ids, from which
documents are put together.

Two folds over the same lattice, chosen by the model's type. For unigram models: Viterbi, the
best sum of scores at each end. For BPE models, such as the public one, the scores are merge
ranks, and the path of the best sum is not what the format prescribes. So for these the fold
applies the merges instead: in each step, of the lattice's edges that join exactly two
current tokens, the one of best rank, leftmost first, takes its inner boundary away. That gives
the ids that the sentencepiece library gives. Boundaries are the bits of one integer, so words over
LATTICE code points, which hardly occur, are merged or searched by the same rules in a task's
Python instead.

Putting together. The dictionary grows with the corpus, more slowly. Its TIER commonest entries
are broadcast in packed form, by 64-bit hashes, at most a few hundred MB; words beyond those are
fetched by a shuffle join for the documents that have them. So the broadcast is bounded and
nothing is dropped. Cutting, hashing, looking up and putting together run over arrays of a
portion of texts at a time. All ids of each document are then decoded and compared with its text,
so that two words of one hash, or any other fault, can't go unseen: such a document is encoded
again word by word.

Characters without a piece become their UTF-8 bytes' pieces, or the unknown id if the model has
none. Null and empty texts have no ids. Repeated rows are encoded alike. An empty table gives an
empty one. Input columns with the name of an output are replaced; working columns take names
that the input hasn't. Decoding joins pieces, drops the leading blank that encoding
adds, skips control ids and gives null for null; a literal U+2581 comes back as a blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import fresh, small_batches, stored, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LATTICE, TIER, FLUSH, PORTION = 48, 4_000_000, 300_000, 1 << 18
PART_BITS = 5
IDS = T.ArrayType(T.IntegerType(), False)
_LOW = 0x250
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_UNIGRAM = 1


class Pieces:
    """What encoding and decoding need of a model file; small, and pickled to the tasks."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        self.unigram = m.trainer_spec.model_type == _UNIGRAM
        self.prefix = m.normalizer_spec.add_dummy_prefix
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("only models whose normaliser leaves texts as they are")
        self.table = [(p.piece, i, float(p.score)) for i, p in enumerate(m.pieces) if p.type in (_NORMAL, _USER)]
        self.longest = max(len(p) for p, _, _ in self.table)
        pairs = {(ord(a) << 32) + ord(b) for p, _, _ in self.table for a, b in zip(p.replace(MARK, " "), p.replace(MARK, " ")[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.apart = np.ones((_LOW + 1, _LOW + 1), bool)  # pairs with a high character are checked by themselves
        self.apart[_LOW, :] = self.apart[:, _LOW] = False
        for a, b in ((x >> 32, x & 0xFFFFFFFF) for x in pairs):
            if a < _LOW and b < _LOW:
                self.apart[a, b] = False
        self.apart = self.apart.ravel()
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == _UNKNOWN)
        of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == _BYTE}
        self.bytes = [of_byte[b] for b in range(256)] if len(of_byte) == 256 else None
        raw = {_BYTE: lambda p: bytes([int(p[3:5], 16)]), _CONTROL: lambda p: b"", _UNKNOWN: lambda p: m.trainer_spec.unk_surface.encode()}
        surface = [raw.get(p.type, lambda p: p.replace(MARK, " ").encode())(p.piece) for p in m.pieces]
        self.surface, self.surface_bytes = np.frombuffer(b"".join(surface), np.uint8), np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_bytes) - self.surface_bytes
        self._ids: dict | None = None

    def cut(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The texts as one string, marks as blanks, where its words start, their hashes, and how many each text has.

        Words end between characters that no piece has side by side. Pairs of low characters are
        looked up in a table, others in a sorted list.
        """
        parts = [((" " if self.prefix else "") + (t.replace(MARK, " ") if MARK in t else t)) if t else "" for t in texts]
        s = "".join(parts)
        if not s:
            return s, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(x) for x in parts], np.int64)
        low = np.minimum(c, _LOW).astype(np.int32)
        first = np.ones(len(c), bool)
        first[1:] = self.apart[low[:-1] * (_LOW + 1) + low[1:]]
        if len(high := np.flatnonzero(low == _LOW)):
            near = np.unique(np.concatenate([high, high - 1]))
            near = near[(near >= 0) & (near < len(c) - 1)]
            code = (c[near].astype(np.int64) << 32) + c[near + 1]
            first[near + 1] = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] != code
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(first)
        words = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - sizes)
        return s, starts, _hashes(c, starts), words

    def words(self, text: str) -> list[str]:
        """The words of a text."""
        s, starts, _, _ = self.cut([text])
        at = [*starts.tolist(), len(s)]
        return [s[a:b] for a, b in zip(at, at[1:])]

    def fallback(self, ch: str) -> list[int]:
        return [self.bytes[b] for b in ch.encode("utf-8")] if self.bytes else [self.unknown]

    def long_word(self, word: str) -> list[int]:
        """The ids of a word of any length, by the rule of the folds."""
        self._ids = self._ids or {p: (i, s) for p, i, s in self.table}
        return self._best_path(word, self._ids) if self.unigram else self._merged(word, self._ids)

    def _merged(self, word: str, ids: dict) -> list[int]:
        import heapq

        n = len(word)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (hit := ids.get(word[a : end[b]])):
                heapq.heappush(queue, (-hit[1], a, b, end[b]))

        for a in range(n - 1):
            offer(a)
        while queue:
            _, a, b, e = heapq.heappop(queue)
            if not (alive[a] and b < n and alive[b] and end[a] == b and end[b] == e):
                continue
            end[a], alive[b] = e, False
            if e < n:
                prev[e] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        return [i for a in range(n) if alive[a] for i in ([ids[word[a : end[a]]][0]] if word[a : end[a]] in ids else self.fallback(word[a : end[a]]))]

    def _best_path(self, word: str, ids: dict) -> list[int]:
        worst = min(s for _, _, s in self.table) - 10
        best: list = [(0.0, 0, [])]
        for e in range(1, len(word) + 1):
            ways = [(best[s][0] + hit[1], -s, [hit[0]]) for s in range(max(0, e - self.longest), e) if (hit := ids.get(word[s:e]))]
            if word[e - 1 : e] not in ids:
                ways.append((best[e - 1][0] + worst, -(e - 1), self.fallback(word[e - 1 : e])))
            score, s, got = max(ways)
            best.append((score, -s, got))
        out, e = [], len(word)
        while e:
            out.append(best[e][2])
            e = best[e][1]
        return [i for x in reversed(out) for i in x]


def _hashes(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, given all their code points and where they start: sums of mixed code points and places."""
    sizes = np.diff(starts, append=len(c))
    v = np.arange(len(c), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), sizes)
    v *= np.uint64(0x9E3779B97F4A7C15)
    v += c * np.uint64(0xD6E8FEB86659FD93)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v ^= v >> np.uint64(shift)
        v *= np.uint64(factor)
    v ^= v >> np.uint64(31)
    return np.add.reduceat(v, starts) if len(starts) else np.zeros(0, np.uint64)


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that cut() gives these words; marks stand for blanks."""
    s = "".join(words).replace(MARK, " ")
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    return _hashes(c, np.cumsum(sizes) - sizes)


def count_words(docs: DataFrame, pieces: Pieces, text: str) -> DataFrame:
    """(word, n) of all documents; n is the number of parts of tasks that hold a word, by which common words are known."""
    small_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in portions(texts):
                s, starts, hashes, _ = pieces.cut(texts[part])
                each, at = np.unique(hashes, return_index=True)
                new = np.array([h not in seen for h in each.tolist()], bool)
                at, ends, s = at[new], np.append(starts[1:], len(s)), s.replace(" ", MARK)
                seen.update(each[new].tolist())
                yield pa.RecordBatch.from_arrays([pa.array([s[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.string())], names=["word"])
                if len(seen) > FLUSH:
                    seen.clear()

    # parts are distinct already, so they are dealt by word without a partial sum, and into as many
    # partitions as the session sets: what a task's lattices take up follows from that
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(text).mapInArrow(found, "word string").repartition(parts, "word").groupBy("word").agg(F.count("*").alias("n"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _merge_path(n: Column, joins: str) -> Column:
    """Boundaries, as bits, that are left when all merges are done; joins are the edges over several characters. The sign marks that none was left."""

    def step(m: Column, _: Column) -> Column:
        fits = lambda x: (m.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(m.bitwiseAND(x["inner"])) == 1)
        best = F.array_min(F.filter(joins, fits))  # by code: rank, then start
        return F.when(m < 0, m).otherwise(F.coalesce(m.bitwiseAND(F.bitwise_not(best["inner"])), m.bitwiseOR(F.lit(_DONE))))

    return F.aggregate(F.sequence(F.lit(1), n), _bit(n + 1) - 1, step, lambda m: m.bitwiseAND(F.lit(~_DONE)))


def _viterbi_path(n: Column, edges: Column, worst: float) -> Column:
    """Boundaries, as bits, of the path of the best sum of scores."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("m")))

    def step(best: Column, e: Column) -> Column:
        known = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), F.get(best, x["s"])["m"].bitwiseOR(_bit(e)).alias("m")))
        alone = F.array(F.struct((F.get(best, e - 1)["score"] + worst).alias("score"), F.get(best, e - 1)["m"].bitwiseOR(_bit(e)).alias("m")))
        lone = F.exists(edges, lambda x: (x["e"] == e) & (x["s"] == e - 1))
        return F.concat(best, F.array(F.array_max(F.when(lone, known).otherwise(F.concat(known, alone)))))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda best: F.get(best, n)["m"])


#: An edge as one integer, which sorts by rank, then start: 20 bits of rank, 6 of start, 6 of end, 20 of id.
_ID, _END, _START, _RANK = 0, 20, 26, 32
_DONE = -(1 << 63)


def _field(x: Column, at: int, bits: int) -> Column:
    return F.shiftright(x, at).bitwiseAND(F.lit((1 << bits) - 1))


def dictionary(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n, ids) from (word, n), by the lattice. Grouping by word needs no shuffle beyond the one that counted."""
    spark = words.sparkSession
    rank_of = {score: k for k, score in enumerate(sorted({-s for _, _, s in pieces.table}))}
    table = spark.createDataFrame([(p, (rank_of[-s] << _RANK) + i, s) for p, i, s in pieces.table], "piece string, code long, score double")
    n = F.length("word")
    # a word too long for the lattice keeps one row
    starts = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.when(n <= LATTICE, n - 1).otherwise(0))).alias("s"))
    span = F.when(n <= LATTICE, F.least(F.lit(pieces.longest), n - F.col("s"))).otherwise(1)
    parts = starts.select("word", "n", "s", F.explode(F.sequence(F.lit(1), span)).alias("k"))
    parts = parts.select("word", "n", "s", (F.col("s") + F.col("k")).alias("e"), F.substring(F.col("word"), F.col("s") + 1, F.col("k")).alias("piece"))
    # pieces that match, and every first character, so that a word without any piece stays
    met = parts.join(F.broadcast(table), "piece", "left").where((F.col("code").isNotNull()) | (F.col("s") == 0) & (F.col("e") == 1))
    code = F.col("code") + (F.col("s") * (1 << (_START - _END)) + F.col("e")).cast("long") * (1 << _END)
    edge = F.struct(code.alias("code"), (_bit(F.col("s")) + _bit(F.col("e"))).alias("ends"), (_bit(F.col("e")) - _bit(F.col("s") + 1)).alias("inner"), *([F.col("s"), F.col("e"), F.col("score")] if pieces.unigram else []))
    several = F.col("e") - F.col("s") >= 2
    known = F.col("code").isNotNull()
    lattice = met.groupBy("word").agg(F.first("n").alias("n"), F.collect_list(F.when(known & several, edge)).alias("joins"), F.collect_list(F.when(known & ~several, edge)).alias("singles"))
    path = _viterbi_path(n, F.concat("joins", "singles"), min(s for _, _, s in pieces.table) - 10) if pieces.unigram else _merge_path(n, "joins")
    lattice = lattice.withColumn("path", F.when(n <= LATTICE, path))
    taken = lambda x: F.col("path").bitwiseAND(x["ends"].bitwiseOR(x["inner"])) == x["ends"]
    in_order = F.sort_array(F.transform(F.concat(F.filter("joins", taken), F.filter("singles", taken)), lambda x: (_field(x["code"], _START, 6) * (1 << 20)).bitwiseOR(_field(x["code"], _ID, 20))))
    lattice = lattice.withColumn("tokens", F.when(F.col("path").isNotNull(), in_order))
    # characters without a piece are boundaries of tokens that no edge covers
    starts = F.filter(F.sequence(F.lit(0), n), lambda i: F.col("path").bitwiseAND(_bit(i)) != 0)
    lattice = lattice.withColumn("cuts", F.when(F.size("tokens") < F.bit_count("path") - 1, starts))
    code = lambda ch, k: F.conv(F.substring(F.hex(F.encode(ch, "utf-8")), 2 * k - 1, F.lit(2)), 16, 10).cast("int")
    ids_of_bytes = F.array(*map(F.lit, pieces.bytes)) if pieces.bytes else None
    spelt = lambda ch: F.transform(F.sequence(F.lit(1), F.octet_length(ch)), lambda k: F.get(ids_of_bytes, code(ch, k))) if pieces.bytes else F.array(F.lit(pieces.unknown))

    def token(s: Column, j: Column) -> Column:
        hit = F.get(F.filter("tokens", lambda x: F.shiftright(x, 20) == s), F.lit(0))
        return F.when(hit.isNotNull(), F.array(_field(hit, _ID, 20).cast("int"))).otherwise(spelt(F.substring(F.col("word"), s + 1, F.lit(1))))

    mixed = F.flatten(F.transform(F.slice("cuts", 1, F.size("cuts") - 1), token))
    ids = F.when(F.col("cuts").isNotNull(), mixed).otherwise(F.transform("tokens", lambda x: _field(x, _ID, 20).cast("int")))
    found = stored(lattice.select("word", "n", ids.alias("ids")))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pieces.long_word(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["word", "n", "ids"])

    far = found.where("ids is null").select("word", "n").mapInArrow(spell, "word string, n long, ids array<int>")
    return found.where("ids is not null").unionByName(far)


def entries(words: DataFrame, wide: bool) -> DataFrame:
    """(part, h, n, ids) of a dictionary (word, ids): hashes, part being the range of hashes, and ids as bytes. Tasks hash and pack, so no word reaches the driver."""
    small_batches(words.sparkSession)
    width = np.dtype("<i4" if wide else "<u2")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hash_words(b.column(0).to_pylist())
            n = np.asarray(pc.list_value_length(b.column(1))).astype(np.int32)
            edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int32) * width.itemsize
            raw = pa.py_buffer(np.asarray(b.column(1).flatten()).astype(width).tobytes())
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(edges.tobytes()), raw])
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - PART_BITS)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n), ids], names=["part", "h", "n", "ids"])

    return stored(words.select("word", "ids").mapInArrow(made, "part int, h long, n int, ids binary"))


class Packed:
    """A dictionary as flat arrays in order of hashes: about 20 bytes an entry.

    The arrays have their sizes from the start, and ranges of hashes are put into them one after the other.
    """

    def __init__(self, total: int, total_ids: int, width: np.dtype):
        self.hashes, self.ids = np.zeros(total, np.uint64), np.zeros(total_ids, width)
        self.at = np.zeros(total + 1, np.uint32 if total_ids < 1 << 32 else np.int64)
        self.held = 0

    @staticmethod
    def of(found: DataFrame, wide: bool) -> Packed:
        """From entries(). The driver holds one range beside the arrays."""
        total, total_ids = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        packed = Packed(total, total_ids, np.int32 if wide else np.uint16)
        for k in range(1 << PART_BITS if total else 0):
            packed.add(found.where(F.col("part") == k).select("h", "n", "ids").toArrow())
            pa.default_memory_pool().release_unused()
        return packed

    def add(self, range_: pa.Table) -> None:
        """The next range: (h, n, ids), in any order."""
        if not range_.num_rows:
            return
        hashes = range_["h"].to_numpy().view(np.uint64)
        n = range_["n"].to_numpy().astype(np.int64)
        ids = np.frombuffer(b"".join(range_["ids"].to_pylist()), self.ids.dtype)
        order = np.argsort(hashes, kind="stable")
        first, end = int(self.at[self.held]), self.held + len(order)
        self.hashes[self.held : end] = hashes[order]
        self.ids[first : first + len(ids)] = _gathered(ids, (np.cumsum(n) - n)[order], n[order])
        self.at[self.held + 1 : end + 1] = first + np.cumsum(n[order])
        self.held = end

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each hash is held, and if so where its ids start and how many they are."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit, at = self.hashes[k] == hashes, self.at[k].astype(np.int64)
        return hit, at, np.where(hit, self.at[k + 1].astype(np.int64) - at, 0)


def _gathered(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of values, each from a place on and of a length, one behind the other."""
    return values[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def portions(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of PORTION characters or little more, so that what their words take up is bounded."""
    at = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= PORTION:
            yield slice(at, k + 1)
            at, held = k + 1, 0
    yield slice(at, len(texts))


class Assembler:
    """Puts documents' ids together from a packed dictionary and, for the rest, what else is known of words."""

    def __init__(self, pieces: Pieces, packed: Packed):
        self.pieces, self.packed = pieces, packed

    def missing(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text that the dictionary lacks."""
        out = []
        for part in portions(texts):
            s, starts, hashes, words = self.pieces.cut(texts[part])
            s, ends = s.replace(" ", MARK), np.append(starts[1:], len(s))
            hit = self.packed.find(hashes)[0]
            for a, b in zip((np.cumsum(words) - words).tolist(), np.cumsum(words).tolist(), strict=True):
                out.append(sorted({s[starts[k] : ends[k]] for k in (a + np.flatnonzero(~hit[a:b])).tolist()}))
        return out

    def encode(self, texts: list[str | None], extra: dict[str, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids and how many each text has; words that neither the dictionary nor extra has are encoded alone."""
        made = [self._portion(texts[part], extra or {}) for part in portions(texts)]
        return tuple(np.concatenate(x) for x in zip(*made, strict=True))

    def _portion(self, texts: list[str | None], extra: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        s, starts, hashes, words = self.pieces.cut(texts)
        each, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        hit, at, n = self.packed.find(each)
        values = self.packed.ids
        if len(lone := np.flatnonzero(~hit)):
            ends = np.append(starts[1:], len(s))
            alone = [s[starts[k] : ends[k]].replace(" ", MARK) for k in first[lone].tolist()]
            more = [extra[w] if w in extra else self.pieces.long_word(w) for w in alone]
            n[lone] = [len(x) for x in more]
            at[lone] = len(values) + np.cumsum(n[lone]) - n[lone]
            values = np.concatenate([values, np.array([i for x in more for i in x], values.dtype)])
        ids = _gathered(values, at[of], n[of]).astype(np.int32)
        tokens = np.concatenate([[0], np.cumsum(n[of])])
        ends = np.cumsum(words)
        sizes = tokens[ends] - tokens[ends - words]
        right = come_back(self.pieces, texts, ids, sizes)
        if all(right):
            return ids, sizes
        one = np.split(ids, np.cumsum(sizes)[:-1])
        for k in np.flatnonzero(~np.array(right)).tolist():
            one[k] = np.array([i for w in self.pieces.words(texts[k] or "") for i in self.pieces.long_word(w.replace(" ", MARK))], np.int32)
        return np.concatenate(one), np.array([len(x) for x in one], np.int64)


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def texts_of(pieces: Pieces, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The UTF-8 texts of arrays of ids that the model has, given all ids and how many each has: pieces joined, less the blank that encoding adds."""
    n = pieces.surface_bytes[ids]
    raw = _gathered(pieces.surface, pieces.surface_at[ids], n).tobytes()
    edges = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [raw[a + (pieces.prefix and raw[a : a + 1] == b" " and a < b) : b] for a, b in zip(edges, edges[1:])]


def come_back(pieces: Pieces, texts: list[str | None], ids: np.ndarray, sizes: np.ndarray) -> list[bool]:
    """Whether the ids of each text, decoded as a whole, give the text; a literal mark comes back as a blank."""
    return [got == (t or "").replace(MARK, " ").encode("utf-8", "surrogatepass") for t, got in zip(texts, texts_of(pieces, ids, sizes), strict=True)]


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", out: str = "ids", tier: int = TIER, check: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with the ids of each text; check names a column that tells whether decoding all ids gives the text back. The driver reads the model file.

    Without keep_text the text is left out, and needn't come back from Python.
    """
    drop = [] if keep_text else [text]
    pieces = Pieces(model)
    spark: SparkSession = docs.sparkSession
    words = stored(dictionary(count_words(docs, pieces, text), pieces))
    total = words.count()
    top = words if total <= tier else stored(words.orderBy(F.desc("n"), "word").limit(tier))
    wide = len(pieces.surface_bytes) > 1 << 16
    shared = spark.sparkContext.broadcast((pieces, Packed.of(entries(top, wide), wide)))
    own: dict = {}  # a task's assembler, kept between batches

    def assembler() -> Assembler:
        if "it" not in own:
            own["it"] = Assembler(*shared.value)
        return own["it"]

    fields = [T.StructField(out, IDS), *([T.StructField(check, T.BooleanType())] if check else [])]

    def made(texts: list[str | None], extra: dict[str, list[int]] | None = None) -> list[pa.Array]:
        ids, sizes = assembler().encode(texts, extra)
        return [_lists(ids, sizes), *([pa.array(come_back(assembler().pieces, texts, ids, sizes), pa.bool_())] if check else [])]

    if total <= tier:
        return with_columns(docs, [text], fields, lambda texts: made(texts.to_pylist()), drop)

    row, more = fresh(docs, "_row", "_more")
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    lacking = with_columns(docs.select(row, text), [text], [T.StructField("word", T.ArrayType(T.StringType()))], lambda texts: [pa.array(assembler().missing(texts.to_pylist()), pa.list_(pa.string()))], [text])
    rest = lacking.select(row, F.explode("word").alias("word")).join(words.select("word", "ids"), "word").groupBy(row).agg(F.collect_list(F.struct("word", "ids")).alias(more))
    joined = docs.join(rest, row, "left")

    def whole(texts: pa.Array, extra: pa.Array) -> list[pa.Array]:
        return made(texts.to_pylist(), {x["word"]: x["ids"] for e in extra.to_pylist() for x in e or []})

    return with_columns(joined, [text, more], fields, whole, [row, more, *drop])


def decode(df: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each array of ids; ids that the model hasn't are skipped."""
    pieces = Pieces(model)

    def texts(rows: pa.Array) -> list[pa.Array]:
        each = [np.array(r or [], np.int64) for r in rows.to_pylist()]
        each = [r[(r >= 0) & (r < len(pieces.surface_at))] for r in each]
        found = texts_of(pieces, np.concatenate([*each, np.zeros(0, np.int64)]), np.array([len(r) for r in each], np.int64))
        return [pa.array([t.decode("utf-8", "replace") if ok else None for t, ok in zip(found, rows.is_valid().to_pylist(), strict=True)], pa.string())]

    return with_columns(df, [ids], [T.StructField(out, T.StringType())], texts)
