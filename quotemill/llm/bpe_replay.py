"""Byte-level BPE by replaying the merges over the corpus' distinct pieces, and decoding.

1. Each task splits its texts by the pattern and writes them as numbers of pieces, in chunks of bounded text. A chunk asks
   for the ids of its distinct pieces: one row for each part of the hash space, with all its pieces there.
2. A part has all chunks' requests for its pieces. Over its distinct pieces an inverted index from token pair to positions
   applies the merges in rank order; a merge changes the entries of its two neighbours only. It answers each chunk.
3. Each chunk's documents are written out as ids from its answers.

Shuffled are a chunk's distinct pieces and their ids, not the texts; the documents as numbers are written in buckets of
their chunk, where the answers come to them. The number of parts grows
with the corpus, and a frequent piece is in a request once a chunk.

A token pair is known by the rank of its joined bytes, so pairs that join to the same token share an entry, as in the
tiktoken library. Like there, a piece that is a token is that token.

Null texts are empty and have no ids. Every row keeps its place: rows that are there twice, share a doc_id or have none
are encoded each. Other columns of the documents, whatever their names, are left out. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache, partial
from heapq import heapify, heappop, heappush
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import keep_bucketed, rows, shuffle_partitions

#: Characters of text in a chunk; a longer document is a chunk of its own.
CHUNK_CHARS = 8_000_000
#: Characters of the corpus for each part of the hash space.
PART_CHARS = 64_000_000
#: Bytes of distinct pieces whose merges are replayed together.
BLOCK_BYTES = 2_000_000
#: Token ids are below this, so that a pair of them is one integer.
ID_SPACE = 1 << 20

ENCODED = "doc_id long, n_tokens long, ids binary"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@cache
def pair_ranks(path: str) -> dict[int, int]:
    """Rank of the joined bytes for each pair of tokens that join to a token."""
    ranks = read_ranks(path)
    halves = ((ranks.get(token[:i]), ranks.get(token[i:]), rank) for token, rank in ranks.items() for i in range(1, len(token)))
    return {a * ID_SPACE + b: rank for a, b, rank in halves if a is not None and b is not None}


def replay(pieces: list[bytes], path: str) -> list[list[int]]:
    """The ids of each distinct piece, all merges replayed over all pieces at once."""
    ranks, pairs = read_ranks(path), pair_ranks(path)
    out: list[list[int] | None] = [[ranks[p]] if p in ranks else None for p in pieces]
    todo = [i for i, ids in enumerate(out) if ids is None and pieces[i]]
    single = [ranks[bytes([b])] for b in range(256)]
    token: list[int] = []
    after: list[int] = []  # position of the next token of the piece, -1 behind the last
    before: list[int] = []
    for i in todo:
        start = len(token)
        token += [single[b] for b in pieces[i]]
        after += [*range(start + 1, len(token)), -1]
        before += [-1, *range(start, len(token) - 1)]
    index: defaultdict[int, list[int]] = defaultdict(list)
    for at, (a, nxt) in enumerate(zip(token, after, strict=True)):
        if nxt >= 0 and (rank := pairs.get(a * ID_SPACE + token[nxt])) is not None:
            index[rank].append(at)
    heap = list(index)
    heapify(heap)
    while heap:
        rank = heappop(heap)
        places = sorted(index.pop(rank))
        for k, at in enumerate(places):
            nxt = after[at]
            if token[at] < 0 or nxt < 0 or pairs.get(token[at] * ID_SPACE + token[nxt]) != rank:
                continue  # one of the two has been merged meanwhile
            token[at], token[nxt] = rank, -1
            prev, far = before[at], after[nxt]
            after[at] = far
            early = False
            if far >= 0:
                before[far] = at
            for left, right in ((prev, at), (at, far)):
                if left >= 0 and right >= 0 and (new := pairs.get(token[left] * ID_SPACE + token[right])) is not None:
                    if new not in index:
                        heappush(heap, new)
                    index[new].append(left)
                    early |= new < rank
            if early and k + 1 < len(places):  # an earlier merge comes first, then the rest of this one
                if rank not in index:
                    heappush(heap, rank)
                index[rank] += places[k + 1 :]
                break
    at = 0
    for i in todo:
        size = len(pieces[i])
        out[i] = [t for t in token[at : at + size] if t >= 0]
        at += size
    return [ids or [] for ids in out]


def to_varints(x: np.ndarray) -> bytes:
    """Numbers below 2^28 in one to four bytes each, seven bits a byte, the lowest first."""
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(4):
        here = size > k
        out[start[here] + k] = ((x[here] >> 7 * k) & 127) | np.where(size[here] > k + 1, 128, 0)
    return out.tobytes()


def from_varints(blob: bytes) -> np.ndarray:
    b = np.frombuffer(blob, np.uint8).astype(np.int64)
    last = np.flatnonzero(b < 128)
    start = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    out = np.zeros(len(last), np.int64)
    for k in range(4):
        here = last - start >= k
        out[here] |= (b[start[here] + k] & 127) << 7 * k
    return out


def squeezed(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(blob)


def unsqueezed(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _id_kind(path: str) -> str:
    return "<u2" if max(read_ranks(path).values()) < 1 << 16 else "<i4"


SPLIT = "chunk long, part int, doc_ids array<long>, codes binary, data binary"


def _split(pattern: str, chunk_chars: int, parts: int):
    """Texts to chunks: rows (chunk, doc_ids, codes = number of pieces of each document, then these) for some documents each,
    one (chunk, part, codes = sizes of pieces, data) for each part that the chunk asks, and one (chunk, part = -1, codes =
    the part of each piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        chunk, size, numbers = TaskContext.get().partitionId() << 32, 0, defaultdict(count().__next__)

        def batch_of(part: list, doc_ids: list, codes: list, data: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([chunk] * len(part), part, doc_ids, codes, data), (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["chunk", "part", "doc_ids", "codes", "data"])

        def closed() -> Iterator[pa.RecordBatch]:
            pieces = [x.encode() for x in numbers]
            sizes = [len(x) for x in codes]
            flat = np.concatenate([*codes, np.zeros(0, np.int32)])
            # frequent pieces get small numbers, those about as frequent follow the alphabet: both make the blobs small
            by_name = np.array(sorted(range(len(pieces)), key=pieces.__getitem__), np.int64)
            often = np.log2(np.bincount(flat, minlength=len(pieces))).astype(np.int64)
            by_name = by_name[np.argsort(-often[by_name], kind="stable")]
            renamed = np.empty(len(pieces), np.int64)
            renamed[by_name] = np.arange(len(pieces))
            flat = renamed[flat]
            ends = np.cumsum([0, *sizes])
            for at in range(0, len(ids), 512):
                n = sizes[at : at + 512]
                yield batch_of([None], [ids[at : at + 512]], [squeezed(to_varints(np.concatenate([np.array(n, np.int64), flat[ends[at] : ends[at + len(n)]]])))], [None])
            if pieces:
                part = np.array([crc32(pieces[i]) % parts for i in by_name.tolist()], np.int64)
                order = np.argsort(part, kind="stable")
                asked, first = np.unique(part[order], return_index=True)
                yield batch_of([-1], [None], [squeezed(to_varints(part))], [None])
                for at, group in zip(asked.tolist(), np.split(by_name[order], first[1:]), strict=True):
                    named = [pieces[i] for i in group.tolist()]
                    yield batch_of([at], [None], [squeezed(to_varints(np.array([len(x) for x in named])))], [squeezed(b"".join(named))])

        ids, codes = [], []
        for batch in rows(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if size and size + len(text or "") > chunk_chars:
                    yield from closed()
                    ids, codes, chunk, size, numbers = [], [], chunk + 1, 0, defaultdict(count().__next__)
                found = find(text or "")
                size += len(text or "")
                ids.append(doc_id)
                codes.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        if ids:
            yield from closed()

    return run


ANSWER = "chunk long, part int, codes binary, data binary"


def _answered(path: str, block_bytes: int):
    """All requests of a part to their answers: (chunk, part, codes = number of ids of each piece, data = ids)."""

    def run(requests: pa.Table) -> pa.Table:
        number = defaultdict(count().__next__)
        asked = []
        for sizes, data in zip(requests["codes"].to_pylist(), requests["data"].to_pylist(), strict=True):
            end, data = np.cumsum(from_varints(unsqueezed(sizes))).tolist(), unsqueezed(data)
            asked.append(np.fromiter((number[data[a:b]] for a, b in zip([0, *end], end)), np.int64, len(end)))  # noqa: B905
        pieces = list(number)
        ends = np.cumsum([0, *map(len, pieces)])
        cuts = [0, *np.searchsorted(ends, np.arange(block_bytes, int(ends[-1]), block_bytes)).tolist(), len(pieces)]
        found = [ids for a, b in zip(cuts, cuts[1:]) for ids in replay(pieces[a:b], path)]  # noqa: B905
        flat, size = np.array([i for ids in found for i in ids], _id_kind(path)), np.array([len(ids) for ids in found], np.int64)
        start = np.cumsum(size) - size
        codes = [squeezed(to_varints(size[x])) for x in asked]
        data = [squeezed(_gathered(flat, start[x], size[x]).tobytes()) for x in asked]
        return pa.table([requests["chunk"], requests["part"], pa.array(codes, pa.binary()), pa.array(data, pa.binary())], ["chunk", "part", "codes", "data"])

    return run


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all, behind each other."""
    stop = np.cumsum(size)
    return flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - size), size)]


def _written_out(path: str, each: Callable[[pa.Table], pa.Table] | None):
    """The ids of a chunk's documents, from its answers and the part of each of its pieces; each is applied to their table."""
    kind = _id_kind(path)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        by_part = sorted(zip(*(answers[c].to_pylist() for c in ("part", "codes", "data")), strict=True))
        size = start = flat = np.zeros(0, np.int64)
        if by_part:  # else no document of the chunk has a character
            order = np.argsort(from_varints(unsqueezed(by_part[0][1])), kind="stable")
            answered = np.concatenate([from_varints(unsqueezed(x[1])) for x in by_part[1:]])
            flat = np.concatenate([np.frombuffer(unsqueezed(x[2]), kind) for x in by_part[1:]])
            size, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            size[order], start[order] = answered, np.cumsum(answered) - answered
        doc_ids, out = [], []
        for ids, blob in zip(docs["doc_ids"].to_pylist(), docs["codes"].to_pylist(), strict=True):
            numbers = from_varints(unsqueezed(blob))
            doc_ids += ids
            for number in np.split(numbers[len(ids) :], np.cumsum(numbers[: len(ids)])[:-1]):
                out.append(_gathered(flat, start[number], size[number]).astype("<i4").tobytes())
        table = pa.table([pa.array(doc_ids, pa.int64()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])
        return each(table) if each else table

    return run


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk_chars: int = CHUNK_CHARS, part_chars: int = PART_CHARS, block_bytes: int = BLOCK_BYTES, each: Callable[[pa.Table], pa.Table] | None = None, schema: str = ENCODED) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of docs(doc_id, text), by the ranks in a file that every executor has. ids are
    little-endian 32-bit integers behind each other; id_lists() has them as arrays. ``each`` turns tables of these rows into ones of
    another schema in the same task.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(shuffle_partitions(spark), -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // part_chars))
    split = keep_bucketed(spark, texts.mapInArrow(_split(pattern, chunk_chars, parts), SPLIT), "pieces", "chunk")
    requests = split.where("part >= 0").select("chunk", "part", "codes", "data")
    answers = requests.groupBy("part").applyInArrow(_answered(path, block_bytes), ANSWER)
    answers = answers.unionByName(split.where("part = -1").select("chunk", "part", "codes", "data"))
    coded = split.where("part is null").select(F.col("chunk").alias("of"), "doc_ids", "codes")
    return coded.groupBy("of").cogroup(answers.groupBy("chunk")).applyInArrow(_written_out(path, each), schema)


def id_lists(encoded: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>) of encode_documents' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            lists = pa.array([np.frombuffer(x or b"", "<i4") for x in batch["ids"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "ids"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>")


@cache
def _spellings(path: str) -> tuple[dict[int, bytes], dict[int, bytes]]:
    """The bytes of each id, and its decimal digits."""
    ranks = read_ranks(path)
    return {rank: token for token, rank in ranks.items()}, {rank: b"%d" % rank for rank in ranks.values()}


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) of encoded(doc_id, ids); an id without a token raises a KeyError. Null ids are empty."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _spellings(path)[0].__getitem__
        for batch in rows(batches):
            decoded = [b"".join(map(of, np.frombuffer(x or b"", "<i4").tolist())) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_table(encoded: pa.Table, path: str) -> pa.Table:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids): of the ids written out, and of what they decode to."""
    of, digits = (x.__getitem__ for x in _spellings(path))
    n, said, back = [], [], []
    for blob in encoded["ids"].to_pylist():
        ids = np.frombuffer(blob or b"", "<i4").tolist()
        n.append(len(ids))
        said.append(hashlib.sha256(b" ".join(map(digits, ids))).hexdigest())
        back.append(hashlib.sha256(b"".join(map(of, ids))).hexdigest())
    return pa.table([encoded["doc_id"], pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """digest_table of a table of encoded documents."""
    path = path or default_path()
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: (b for batch in batches for b in digest_table(pa.Table.from_batches([batch]), path).to_batches()), DIGESTS)


def encoded_digests(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """token_digests of encode_documents, where the ids are made."""
    path = path or default_path()
    return encode_documents(spark, docs, path, each=partial(digest_table, path=path), schema=DIGESTS)
