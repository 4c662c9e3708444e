"""SentencePiece encoding and decoding, with a parallel scan over the chunks of giant documents.

The encoding of a text is the only sequence of pieces in which every two neighbours encode to
themselves. So a text can be cut anywhere: what a chunk needs to know of the text before it is
which piece reaches over its first character, its boundary state. A chunk yields a transfer matrix
from the states at its beginning to those at its end, with the weights 0 (the pieces in between
can follow each other) and minus infinity. Matrices are combined in the max-plus algebra, which is
associative; the best path through a document fixes all boundary states, and then every chunk is
encoded by itself.

No piece contains a blank behind another character, nor a line end, so every such place in a chunk
is a state of its own and the matrix only needs the text before the first and after the last of
them. A text of one chunk is encoded at once, word by word with a cache of bounded size.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from tallyloom.llm.shared import by_batches, slices, stored, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15
CACHE = 1 << 17
#: A word with the blanks before it, or a line end: no piece reaches over the borders of these.
SEGMENT = re.compile(r"\n| *[^ \n]+| +")
BORDER = re.compile(r"(?<=[^ ])(?= )|(?=\n)|(?<=\n)")
#: State before the first piece of a text or behind a border; any piece may follow it.
FREE = -1
SPACE = "▁"


class Pieces:
    """A SentencePiece model in a task: encoding, decoding, and which pieces can be neighbours."""

    def __init__(self, proto: bytes) -> None:
        spec = ModelProto.FromString(proto)
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("Only models that leave the text as it is can be cut anywhere.")
        self.prefix = " " if rules.add_dummy_prefix else ""
        rules.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.cache: dict[str, array] = {}
        self.bytes: list[bytes] = []
        self.ids: dict[str, int] = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes.append(b"")
            else:
                text = piece.replace(SPACE, " ")
                self.bytes.append(text.encode())
                if self.model.encode(text) == [i]:
                    self.ids[text] = i
        self.texts = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.borders = not any(re.search(r"[^ ] |\n", t) for t in self.ids)
        self.follows = lru_cache(maxsize=CACHE)(self._follows)

    def encode(self, text: str | None) -> array:
        """Ids of a whole text; models may put a blank before it."""
        return self.part((self.prefix + text).replace(SPACE, " ")) if text else array("i")

    def part(self, text: str) -> array:
        """Ids of a text as it stands."""
        if not self.borders:
            return array("i", self.model.encode(text))
        cache, out = self.cache, array("i")
        for segment in SEGMENT.findall(text):
            ids = cache.get(segment)
            if ids is None:
                ids = array("i", self.model.encode(segment))
                if len(segment) <= 32:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[segment] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").removeprefix(self.prefix)

    def _follows(self, a: int, b: int) -> bool:
        return self.model.encode(self.texts[a] + self.texts[b]) == [a, b]

    def at(self, text: str, place: int) -> list[tuple[int, int]]:
        """Pieces that stand at a place of the text, with their ends; an unknown character is FREE."""
        found = []
        for end in range(place + 1, min(len(text), place + self.longest) + 1):
            piece = self.ids.get(text[place:end])
            if piece is not None:
                found.append((end, piece))
        if text[place] not in self.ids:
            found.append((place + 1, FREE))
        return found

    def states(self, before: str, after: str) -> list[tuple[int, int]]:
        """Pieces that could reach up to or over a cut, as (characters beyond the cut, piece)."""
        text, cut = before + after, len(before)
        found = {
            (end - cut, piece)
            for start in range(max(0, cut - self.longest), cut)
            for end, piece in self.at(text, start) if end >= cut
        }
        return sorted(found)

    def reach(self, text: str, start: int, stop: int, sources: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
        """From sources (place, piece) to all pieces that begin before ``stop`` and reach it.

        The value has a bit for every source that leads there.
        """
        active: dict[int, dict[int, int]] = {}
        for i, (place, piece) in enumerate(sources):
            own = active.setdefault(place, {})
            own[piece] = own.get(piece, 0) | 1 << i
        for place in range(start, stop):
            now = active.pop(place, None)
            if not now:
                continue
            for end, piece in self.at(text, place):
                mask = 0
                for last, bits in now.items():
                    if last == FREE or piece == FREE or self.follows(last, piece):
                        mask |= bits
                if mask:
                    own = active.setdefault(end, {})
                    own[piece] = own.get(piece, 0) | mask
        return {(place, piece): bits for place, own in active.items() for piece, bits in own.items()}

    def transfer(self, before: str, body: str, after: str) -> tuple[list, list, np.ndarray]:
        """States at both ends of a chunk and the max-plus matrix between them."""
        text, size = body + after, len(body)
        first = self.states(before, text[: self.longest]) if before else [(0, FREE)]
        last = self.states(body[-self.longest :], after) if after else [(0, FREE)]
        matrix = np.full((len(first), len(last)), -np.inf)
        cuts = [m.start() for m in BORDER.finditer(body)] if self.borders else []
        if cuts:
            begin = self.reach(text, 0, cuts[0], first)
            ok = 0
            for (place, _), bits in begin.items():
                if place == cuts[0]:
                    ok |= bits
            ends = self.reach(text, cuts[-1], size, [(cuts[-1], FREE)])
            rows = [i for i in range(len(first)) if ok >> i & 1]
            hit = {(p - size, piece) for p, piece in ends}
            for j, state in enumerate(last):
                if state in hit or (not after and any(p == 0 for p, _ in hit)):
                    matrix[rows, j] = 0.0
        else:
            ends = self.reach(text, 0, size, first)
            for (p, piece), bits in ends.items():
                state = (p - size, piece) if after else (0, FREE)
                if (after or p == size) and state in last:
                    for i in range(len(first)):
                        if bits >> i & 1:
                            matrix[i, last.index(state)] = 0.0
        return first, last, matrix


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices in the max-plus algebra."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=-np.inf)


def scan(matrices: list[np.ndarray]) -> list[int] | None:
    """The state at the beginning of every chunk on the best path; None if there isn't just one."""
    forward = [np.zeros((1, matrices[0].shape[0]))]
    for m in matrices:
        forward.append(max_plus(forward[-1], m))
    backward = [np.zeros((matrices[-1].shape[1], 1))]
    for m in reversed(matrices):
        backward.append(max_plus(m, backward[-1]))
    chosen = []
    for f, b in zip(forward[:-1], reversed(backward[1:])):
        on_path = np.flatnonzero(np.isfinite(f[0] + b[:, 0]))
        if len(on_path) != 1:
            return None
        chosen.append(int(on_path[0]))
    return chosen


def _lists(rows: list[array | None]) -> pa.ListArray:
    """Arrays of ids as one column; None stays null."""
    ends = np.cumsum([0, *(len(r) if r is not None else 0 for r in rows)]).astype(np.int32)
    flat = np.concatenate([np.frombuffer(r, np.int32) for r in rows if r] or [np.zeros(0, np.int32)])
    missing = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=missing)


_LOADED: dict[int, Pieces] = {}


def _pieces(proto) -> Pieces:
    """One model per Python worker."""
    key = hash(proto.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(proto.value)
    return _LOADED[key]


def load_model(spark: SparkSession, path: str = MODEL):
    """The model file, read once on the driver and sent to the tasks; half a megabyte."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _fields(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema)


def _cut(giants: DataFrame, chunk: int, reach: int) -> DataFrame:
    """Chunks of documents, with the text right before and after each."""
    def run(batches):
        names = ["own_id", "own_hash", "number", "before", "body", "after"]
        for batch in slices(batches):
            for doc_id, own_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for number, at in enumerate(range(0, len(text), chunk)):
                    end = min(at + chunk, len(text))
                    row = (doc_id, own_hash, number, text[max(0, at - reach) : at], text[at:end], text[end : end + reach])
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = giants.schema["own_id"].dataType.simpleString()
    ddl = f"own_id {kind}, own_hash long, number int, before string, body string, after string"
    schema = to_arrow_schema(giants.sparkSession.createDataFrame([], ddl).schema)
    return giants.mapInArrow(run, ddl)


def _encode_giants(giants: DataFrame, proto, chunk: int) -> DataFrame:
    """own_id, own_hash and ids of documents of more than one chunk, by the parallel scan."""
    key = ["own_id", "own_hash"]
    reach = _pieces(proto).longest
    kind = giants.schema["own_id"].dataType.simpleString()
    chunks = stored(_cut(giants, chunk, reach).repartition("own_id", "own_hash", "number"))

    def matrices(columns):
        pieces = _pieces(proto)
        read = [pieces.transfer(*row) for row in zip(*(columns[c].to_pylist() for c in ("before", "body", "after")))]
        return {c: columns[c] for c in (*key, "number")} | {
            "beyond": [[p for p, _ in first] for first, _, _ in read],
            "width": [m.shape[1] for _, _, m in read],
            "matrix": [m.ravel().tolist() for _, _, m in read],
        }

    moves = by_batches(
        chunks, matrices,
        f"own_id {kind}, own_hash long, number int, beyond array<int>, width int, matrix array<double>",
    )

    def best_path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        parts = [np.asarray(m).reshape(-1, w) for m, w in zip(pdf.matrix, pdf.width)]
        chosen = scan(parts)
        starts = [int(b[i]) for b, i in zip(pdf.beyond, chosen)] if chosen else [None] * len(pdf)
        ends = starts[1:] + [0 if chosen else None]
        return pd.DataFrame({
            "path_id": pdf.own_id, "path_hash": pdf.own_hash, "path_number": pdf.number,
            "skip": pd.array(starts, dtype="Int32"), "more": pd.array(ends, dtype="Int32"),
        })

    # A group holds the small matrices of one document.
    paths = moves.groupBy(*key).applyInPandas(
        best_path, f"path_id {kind}, path_hash long, path_number int, skip int, more int"
    )
    joined = chunks.join(
        stored(paths),
        F.col("own_id").eqNullSafe(F.col("path_id")) & (F.col("own_hash") == F.col("path_hash"))
        & (F.col("number") == F.col("path_number")),
    )

    def encode(columns):
        pieces = _pieces(proto)
        rows = zip(*(columns[c].to_pylist() for c in ("body", "after", "skip", "more")))
        return {c: columns[c] for c in (*key, "number")} | {
            "ids": _lists([None if skip is None else pieces.part(body[skip:] + after[:more]) for body, after, skip, more in rows])
        }

    coded = by_batches(joined, encode, f"own_id {kind}, own_hash long, number int, ids array<int>")
    # A group holds one document.
    whole = coded.groupBy(*key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", "ids"))), lambda x: x["ids"])).alias("ids")
    )
    return stored(whole)


def encode(docs: DataFrame, proto, chunk: int = CHUNK, with_decoded: bool = False) -> DataFrame:
    """All columns of docs with ids, the piece ids of the text as the library itself gives them.

    ``proto`` comes from load_model. Texts of more than ``chunk`` characters go through the
    parallel scan; should a model have no unique path for one, it is encoded in one piece. Null and
    empty texts have no ids. ``with_decoded`` adds decoded, what ``decode`` makes of the ids, mostly
    in the same pass. Repeated rows are encoded alike; columns of docs named so are replaced; an
    empty table gives an empty result.
    """
    added = ("ids", "decoded") if with_decoded else ("ids",)
    kept = [c for c in docs.columns if c.lower() not in added]
    source = docs.select(*kept)

    def run(columns):
        pieces = _pieces(proto)
        ids = [pieces.encode(t) for t in columns["text"].to_pylist()]
        out = {c: columns[c] for c in kept} | {"ids": _lists(ids)}
        return out | {"decoded": [pieces.decode(i) for i in ids]} if with_decoded else out

    schema = f"{_fields(docs, kept)}ids array<int>"
    giant = F.length(whole_text()) > chunk
    short = by_batches(source.filter(~giant), run, schema + (", decoded string" if with_decoded else ""))
    giants = source.filter(giant)
    named = giants.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"), "text")
    named = named.withColumn("text", F.translate(F.concat(F.lit(_pieces(proto).prefix), "text"), SPACE, " "))
    coded = _encode_giants(named.dropDuplicates(["own_id", "own_hash"]), proto, chunk).select(
        F.col("own_id").alias("__id"), F.col("own_hash").alias("__hash"), F.col("ids").alias("__ids")
    )
    joined = giants.join(
        coded, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    ).select(*kept, F.col("__ids").alias("ids"))

    def finish(columns):
        pieces = _pieces(proto)
        ids = []
        for text, own in zip(columns["text"].to_pylist(), columns["ids"]):
            ids.append(array("i", own.values.to_numpy()) if own.is_valid else pieces.encode(text))
        out = {c: columns[c] for c in kept} | {"ids": _lists(ids)}
        return out | {"decoded": [pieces.decode(i) for i in ids]} if with_decoded else out

    return short.unionByName(by_batches(joined, finish, schema + (", decoded string" if with_decoded else "")))


def decode(coded: DataFrame, proto, ids: str = "ids") -> DataFrame:
    """All columns with decoded, the text of the ids; null ids give an empty text.

    Equals the text that was encoded, but for U+2581, which SentencePiece reads as a blank.
    """
    kept = [c for c in coded.columns if c.lower() != "decoded"]

    def run(columns):
        pieces = _pieces(proto)
        rows = (i.values.to_numpy() if i.is_valid else () for i in columns[ids])
        return {c: columns[c] for c in kept} | {"decoded": [pieces.decode(i) for i in rows]}

    return by_batches(coded.select(*kept), run, f"{_fields(coded, kept)}decoded string")
