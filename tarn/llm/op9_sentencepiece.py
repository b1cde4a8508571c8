"""SentencePiece encoding and decoding by a distinct-chunk table. Pieces of this kind of model hold the white-space
marker only at their start, so no merge crosses from a letter to the next marker: a text falls into chunks (a run of
markers and what follows), each distinct chunk is segmented once, and ids are joined back by position.

Scale: the table lies in shards, by a hash of the chunk. Texts are taken in batches of BATCH_TOKENS chunks or BATCH_BYTES;
a batch asks each shard for its distinct chunks there in one packed row, so that a chunk that stands in every text costs
one entry a batch, and keeps its texts as chunk numbers by position. A shard answers as rows stream by and segments a
chunk when it first meets it; if its part of the table should outgrow TABLE_BYTES it is begun anew, and chunks are then
segmented again. Answers and numbers meet by batch. Texts themselves aren't shuffled. A batch's key is a digest
of what it holds, so a task that is run again gives the same rows, or, if its input came in another order, rows that
don't match the ones before, which is an error and never a wrong result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import parts, ship, table
from tarn.llm.packing import LEVEL, Numbers, by_group, pack, small, unpack

BATCH_TOKENS, BATCH_BYTES, TABLE_BYTES, SLICE = 3_000_000, 24 << 20, 128 << 20, 200_000
MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")
#: What models with a normaliser change: blanks, wide and joined letters, signs, accents, case.
PROBE = " \uff21  \ufb01 \u2460\te\u0301 \u00c9 "


def chunks_of(text: str | None) -> list[str]:
    """The text's chunks in order, each without its first marker: as spaces and a word."""
    text = (text or "").replace(MARK, " ")
    if "  " in text or text[:1] == " ":
        return [c[1:] for c in _CHUNK.findall(" " + text)]
    return text.split(" ") if text else []


class Segmenter:
    """Ids of chunks by the library, each distinct chunk once. Raises ValueError for a model whose pieces cross white space,
    or that does not take texts as they are behind one marker: its normaliser may change what chunks are cut at."""

    def __init__(self, model: bytes, limit: int = TABLE_BYTES):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        if crossing := [s for i in range(p.vocab_size()) if MARK in (s := p.id_to_piece(i)).lstrip(MARK)]:
            raise ValueError(f"pieces cross white space: {crossing[:3]}")
        if (normal := p.normalize(PROBE)) != MARK + PROBE.replace(" ", MARK):
            raise ValueError(f"the model normalises texts: {PROBE!r} becomes {normal!r}")
        # The library puts one marker before what it encodes: that of the chunk itself.
        self.empty = np.array([p.piece_to_id(MARK)], dtype="<u4").tobytes()
        self.limit, self.size, self.known, self.segmented = limit, 0, {"": self.empty}, 0

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of each chunk."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if new:
            if self.size > self.limit:
                self.size, new = 0, chunks
                known = self.known = {}
            for c, ids in zip(new, self.processor.encode(new)):
                known[c] = np.array(ids, dtype="<u4").tobytes() if c else self.empty
                self.size += 150 + 4 * len(c)
            self.segmented += len(new)
        return [known[c] for c in chunks]


class Batch:
    """Texts as numbers of their chunks."""

    def __init__(self):
        self.numbers, self.docs, self.texts, self.tokens, self.bytes, self.digest = Numbers(), [], [], 0, 0, xxhash.xxh3_64()

    def add(self, doc_id, text: str | None) -> None:
        chunks = chunks_of(text)
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, chunks), dtype=np.int32, count=len(chunks)))
        self.docs.append(doc_id)
        self.tokens += len(chunks) + 1
        self.bytes += len(text or "")
        self.digest.update(repr(doc_id).encode() + (text or "").encode("utf-8", "surrogatepass"))

    def rows(self, place: int, shards: int):
        """Rows key, target, docs, data. First one with the ids of the documents and their numbers, then one for each shard
        with the chunks that lie there, in the order of their numbers."""
        self.digest.update(str(place).encode())
        key = self.digest.intdigest() >> 1
        sizes, numbers, chunks = np.array([len(t) for t in self.texts]), np.concatenate(self.texts), list(self.numbers)
        # frequent chunks get small numbers, which pack better
        order = np.argsort(-np.bincount(numbers, minlength=len(chunks)), kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order))
        numbers, chunks = rank[numbers], [chunks[i] for i in order.tolist()]
        shard = np.fromiter((xxhash.xxh3_64_intdigest(c.encode("utf-8", "surrogatepass")) % shards for c in chunks), dtype=np.int64, count=len(chunks))
        yield key, key % shards, self.docs, pack(small(sizes), small(numbers), small(shard), level=6)
        for g, at in by_group(shard, shards):
            yield key, g, None, zstandard.compress(MARK.join([chunks[i] for i in at.tolist()]).encode("utf-8", "surrogatepass"), LEVEL)


def assemble(docs: list, data: bytes, answers: list[tuple[int, bytes]], decode, ends: tuple[int, int] | None) -> tuple[list[bytes], list[str]]:
    """Packed ids and decoded text of each of a batch's documents."""
    sizes, numbers, shard = (a.astype(np.int64) for a in unpack(data))
    counts, ids = np.zeros(len(shard), dtype=np.int64), []
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], [a for a, _ in answers])
    for edge, (_, packed) in zip(edges.tolist(), answers):
        n, own = unpack(packed)
        counts[order[edge : edge + len(n)]] = n
        ids.append(own.astype("<u4"))
    if not counts.all():
        raise RuntimeError("a batch lacks chunks: its input came in another order when a task was run again")
    flat = np.concatenate([*ids, np.zeros(0, dtype="<u4")])
    starts = np.zeros(len(shard), dtype=np.int64)
    starts[order] = np.cumsum(counts[order]) - counts[order]
    begin, end = ([np.array([e], dtype="<u4")] if ends else [] for e in ends or (0, 0))
    out, text, first = [], [], np.concatenate(([0], np.cumsum(sizes)))
    doc = 0
    while doc < len(docs):
        last = max(doc + 1, int(np.searchsorted(first, first[doc] + SLICE, side="right")) - 1)
        own = numbers[first[doc] : first[last]]
        n = counts[own]
        done = np.concatenate(([0], np.cumsum(n)))
        joined = flat[np.repeat(starts[own] - done[:-1], n) + np.arange(done[-1])]
        for k in range(doc, last):
            a, b = done[first[k] - first[doc]], done[first[k + 1] - first[doc]]
            coded = np.concatenate([*begin, joined[a:b], *end]) if ends else joined[a:b]
            out.append(coded.tobytes())
            text.append(decode(coded.tolist()))
        doc = last
    return out, text


def sentencepiece_round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", begin_end: bool = True, shards: int | None = None, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Returns doc_id, ids (packed little-endian uint32) and decoded (text), one row for each input row.

    A null text is an empty text. Repeated rows are each encoded; extra columns are left out. An empty table gives an
    empty result. model_path is read by the driver. shards: as many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    n = shards or parts(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def number(batches):
        from pyspark import TaskContext

        seq, held, types = 0, Batch(), None

        def flush():
            for row in held.rows((TaskContext.get().partitionId() << 24) + seq, n):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["key", "target", "docs", "data"])

        for batch in batches:
            types = [pa.int64(), pa.int32(), pa.list_(batch.schema.field(0).type), pa.binary()]
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.add(doc_id, text)
                    if held.tokens >= batch_tokens or held.bytes >= BATCH_BYTES:
                        yield from flush()
                        seq, held = seq + 1, Batch()
        if held.docs:
            yield from flush()

    def answer(batches):
        s = Segmenter(model.value)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                if row.column(2)[0].as_py() is None:
                    ids = s.ids(zstandard.decompress(row.column(3)[0].as_py()).decode("utf-8", "surrogatepass").split(MARK))
                    data = pack(small(np.array([len(i) // 4 for i in ids])), small(np.frombuffer(b"".join(ids), dtype="<u4")))
                    row = row.set_column(3, "data", pa.array([data], pa.binary()))
                yield row

    def gather(group: pa.Table) -> pa.Table:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        shard, ids, data = (group.column(c).to_pylist() for c in ("target", "docs", "data"))
        own = next((i for i, d in enumerate(ids) if d is not None), None)
        if own is None:
            raise RuntimeError("a batch lacks its numbers: its input came in another order when a task was run again")
        answers = sorted((s, d) for s, i, d in zip(shard, ids, data) if i is None)
        coded, decoded = assemble(ids[own], data[own], answers, p.decode, (p.bos_id(), p.eos_id()) if begin_end else None)
        return pa.Table.from_arrays([pa.array(ids[own], group.schema.field("docs").type.value_type), pa.array(coded, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"key long, target int, docs array<{kind}>, data binary"
    answered = texts.mapInArrow(number, schema).repartitionById(n, "target").mapInArrow(answer, schema)
    return answered.groupBy("key").applyInArrow(gather, f"doc_id {kind}, ids binary, decoded string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(coded: DataFrame) -> DataFrame:
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(sentencepiece_round_trip(table(spark, sf_dir, "documents"), default_model()))
