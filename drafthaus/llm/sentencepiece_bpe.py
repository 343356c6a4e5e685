"""SentencePiece BPE by a prefix table, and its decoding.

Every prefix of a BPE-encoded string has an encoding of its own, and all of them agree on the tokens before the last
one.  So it's enough to store the last token of each prefix: of the vocabulary's pieces that end there (an automaton
finds them), it is the one piece that is compatible with the last token of the prefix before it, which is a test of
that pair alone.  The ids are then read from the table backwards.  The time is linear in the text.

Text is cut where no piece can span: before the space mark, and around characters that are no piece (these become
byte pieces).  Encodings of short cuts are kept, as words repeat.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, in_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Cuts up to this length are kept, so many at a time (about 300 bytes each), until a task ends; and pairs of tokens.
KEPT_CHARS, KEPT, PAIRS = 48, 400_000, 600_000


class _Kept(dict):
    """Entries of short cuts; emptied when full, as it only saves time."""

    def __init__(self, bpe):
        super().__init__()
        self.bpe, self.most = bpe, KEPT

    def __missing__(self, cut: str):
        if len(self.bpe.pairs) > PAIRS:
            self.bpe.pairs.clear()
        found = self.bpe.entry(cut)
        if len(cut) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[cut] = found
        return found


class PieceBPE:
    """Encodes and decodes as the library does with a BPE model with byte fallback and no normalisation rules."""

    def __init__(self, serialized: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(serialized)
        spec, trainer = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if trainer.model_type != 2 or not trainer.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or kinds & {USER, UNUSED} or trainer.treat_whitespace_as_suffix:
            raise ValueError("not a BPE model with byte fallback and plain text")
        self.dummy = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.names = [str(i) for i in range(len(self.pieces))]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with a space inside")
        scores = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        self.rank = {i: scores[model.pieces[i].score] for i in normal.values()}  # low ranks merge first, of equal ones the left
        self.bytes_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kind[i] == BYTE}
        self.id_byte = {i: b for b, i in self.bytes_id.items()}
        self.normal = normal
        self.chars = {c for p in normal for c in p}
        if any(c not in normal for c in self.chars):
            raise ValueError("pieces with characters that are no pieces")
        self.split: dict[int, tuple[int, int]] = {}  # of a piece: the two that it is merged from last
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in normal.items():
            if len(p) > 1:
                halves = self._merged(p)
                if len(halves) != 1:
                    continue  # never made by merging
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+") if "\n" not in normal else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.unknown = re.compile(f"[^{re.escape(''.join(sorted(self.chars)))}]", re.DOTALL)
        self.kept = _Kept(self)

    def _merged(self, text: str) -> list[int]:
        """The plain way, merge by merge, for the pieces themselves; notes how each is made."""
        ids = [self.normal[c] for c in text]
        while len(ids) > 1:
            best = None
            for k in range(len(ids) - 1):
                m = self.normal.get(self.pieces[ids[k]] + self.pieces[ids[k + 1]])
                if m is not None and (best is None or self.rank[m] < best[0]):
                    best = (self.rank[m], k, m)
            if best is None:
                break
            _, k, m = best
            self.split.setdefault(m, (ids[k], ids[k + 1]))
            ids[k : k + 2] = [m]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of the two, encoded, is the two again: no merge across their border comes before the
        merges that make them.  Undoes merges at the border from the last to the first."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        pieces, normal, rank, split = self.pieces, self.normal, self.rank, self.split
        # limit: the merges undone so far are at this rank or later, to the left of an equal one or not
        limit = 1 << 40
        while True:
            m = normal.get(pieces[a] + pieces[b])
            if m is not None and rank[m] * 2 < limit:
                return False
            ra, rb = rank[a] if a in split else -1, rank[b] if b in split else -1
            if ra < 0 and rb < 0:
                return True
            # of merges at one rank the left one is first, so that of the right piece is undone first
            if ra > rb:
                limit, a = ra * 2, split[a][1]
            else:
                limit, b = rb * 2 + 1, split[b][0]

    def _known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        n = len(text)
        last, size = [0] * n, [0] * n
        pairs = self.pairs
        for end, (piece, length) in self.automaton.iter(text):  # pieces that end here, the long ones first
            if size[end]:
                continue
            before = end - length
            if before >= 0:
                key = last[before] << 20 | piece
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = self._compatible(last[before], piece)
                if not ok:
                    continue
            last[end], size[end] = piece, length
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _segment(self, text: str) -> list[int]:
        out: list[int] = []
        begin = 0
        for found in self.unknown.finditer(text):
            k = found.start()
            if begin < k:
                out += self._known(text[begin:k])
            out += [self.bytes_id[b] for b in found.group().encode("utf-8")]
            begin = k + 1
        if begin < len(text):
            out += self._known(text[begin:]) if begin else self._known(text)
        return out

    def cuts(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall((SPACE if self.dummy else "") + text.replace(" ", SPACE))

    def entry(self, cut: str) -> tuple[str, int, str]:
        """(ids joined by commas, their number, the text decoded from them) of a cut."""
        if self.unknown.search(cut):
            ids = self._segment(cut)
            return ",".join([str(i) for i in ids]), len(ids), self._surface(ids)
        ids, pieces, names = self._known(cut), self.pieces, self.names
        return ",".join([names[i] for i in ids]), len(ids), "".join([pieces[i] for i in ids]).replace(SPACE, " ")

    def _surface(self, ids) -> str:
        """Text of ids, with the spaces; bytes that aren't UTF-8 become U+FFFD."""
        out, held = [], bytearray()
        for i in ids:
            kind = self.kind[i]
            if kind == BYTE:
                held.append(self.id_byte[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            out.append("" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else self.pieces[i].replace(SPACE, " "))
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.both(text)[0].split(",") if i]

    def decode(self, ids) -> str:
        text = self._surface(ids)
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        starts = first is not None and self.kind[first] == NORMAL and self.pieces[first].startswith(SPACE)
        return text[1:] if self.dummy and starts else text

    def both(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by commas, their number, the text decoded from them)."""
        kept = self.kept
        found = [kept[c] for c in self.cuts(text or "")]
        decoded = "".join([f[2] for f in found])
        if self.dummy and found:
            decoded = decoded[1:]  # the first piece begins with the space put before the text
        return ",".join([f[0] for f in found]), sum([f[1] for f in found]), decoded


def _utf8(raw: bytes) -> str:
    """As the library decodes: each byte that begins no character becomes one U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode("utf-8"))
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load(serialized: bytes) -> PieceBPE:
    return PieceBPE(serialized)


def _shared_model(spark, path: str):
    """The model file, read on the driver and sent to the executors once (half a megabyte)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_TYPES = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64()), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
#: Texts whose outputs make one batch.
ROWS = 200


def sentencepiece_round_trip(docs: DataFrame, model: str, outputs=("ids", "decoded"), keep=("doc_id",), text_col: str = "text", cache: int = KEPT) -> DataFrame:
    """Encodes each text with the model file at the path (read on the driver) and decodes the ids again.

    Returns one row per row of docs: the columns of docs named in keep and the outputs, of: ids, n_tokens, decoded,
    ids_sha256 (hexadecimal, of the decimal ids joined by commas), decoded_sha256 (of the decoded text in UTF-8).

    A null or empty text has no ids and decodes to ''.  The decoded text is the text itself, but that the space mark
    U+2581 becomes a space.  Null ids are kept, repeated rows come back as often, other columns aren't read; a kept
    column with the name of an output raises ValueError.  An empty table gives no rows.  cache: encodings of short cuts
    that a task keeps, which costs memory and saves time; results don't depend on it.
    """
    wanted = list(outputs)
    if set(wanted) & set(keep) or set(wanted) - set(_TYPES):
        raise ValueError(f"outputs: of {', '.join(_TYPES)}, and no kept column of that name")
    shared = _shared_model(docs.sparkSession, model)
    make = {
        "ids": lambda joined, n, decoded: [int(i) for i in joined.split(",")] if n else [],
        "n_tokens": lambda joined, n, decoded: n,
        "decoded": lambda joined, n, decoded: decoded,
        "ids_sha256": lambda joined, n, decoded: hashlib.sha256(joined.encode()).hexdigest(),
        "decoded_sha256": lambda joined, n, decoded: hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
    }

    def run(batches):
        bpe = load(shared.value)
        bpe.kept.most = cache
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                columns: list[list] = [[] for _ in wanted]
                for text in batch.column(batch.num_columns - 1).slice(first, ROWS).to_pylist():
                    found = bpe.both(text)
                    for o, out in zip(wanted, columns):
                        out.append(make[o](*found))
                kept = [batch.column(i).slice(first, ROWS) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, _TYPES[o][1]) for o, c in zip(wanted, columns)], names=names)
        bpe.kept.clear()  # the worker goes on to other tasks
        bpe.pairs.clear()
        give_back()

    source = in_batches(docs).select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    schema = source.drop("_text").schema
    names = [f"k{i}" for i in range(len(keep))] + wanted
    out = source.mapInArrow(run, ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(schema)), *(f"{o} {_TYPES[o][0]}" for o in wanted)]))
    return out.toDF(*keep, *wanted)


def decode_ids(df: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of an array of ids, as the library's decode(ids) gives it; null for a null array.

    Ids outside the vocabulary raise an error, as in the library."""
    shared = _shared_model(df.sparkSession, model)

    def run(series: pd.Series) -> pd.Series:
        bpe = load(shared.value)
        return series.map(lambda ids: None if ids is None else bpe.decode([int(i) for i in ids]))

    return df.withColumn(out_col, F.pandas_udf(run, "string")(F.col(ids_col)))
