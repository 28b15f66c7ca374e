"""Operator 8: SentencePiece encoding and decoding by a distinct-chunk table.

The model's pieces never hold a white-space marker after another character,
so no merge crosses the start of a marker run: a marked text is cut before
each run, every distinct chunk is segmented once by the library and kept in
a table, and a document's ids are the chunks' ids joined in order of position.

The table lives in each Python worker (``table_size`` chunks at most, emptied
when full), because joining 10**11 word occurrences back through a shuffle
would move many times the corpus, while the documents themselves need no
shuffle at all. Chunks over ``LONGEST`` characters are segmented directly.

So the method is kept within a worker only: a chunk is segmented once in each, and
again if its table was emptied. A table of the whole corpus was weighed and left;
the README has the figures.

Edge cases: null text is the empty text; an empty text has the end id only and
decodes to the empty text; texts of any length are encoded whole; repeated rows
give repeated rows; a null id is kept as such; an empty table gives no rows; extra
columns are kept by ``encode`` unless they clash with its own names, which then win.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.common import exact, table

MARK = "▁"
LONGEST = 64
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def crossing_pieces(pieces: Iterable[str]) -> list[str]:
    """Pieces that hold a marker after another character: with any of them
    chunks would not be independent."""
    return [p for p in pieces if MARK in p.lstrip(MARK)]


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker and with spaces
    for the others; encoding one adds the first marker back."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:].replace(MARK, " ") for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]


class ChunkTable:
    """Chunk -> (number of ids, ids as text, decoded text)."""

    def __init__(self, model: str, table_size: int) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size, self.rows = table_size, {}
        self.end = self.lib.eos_id()
        #: A marker with nothing after it (a trailing space); encode("") would be empty.
        self.alone = (1, str(self.lib.piece_to_id(MARK)), "")
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.marked = [p.startswith(MARK) for p in pieces]
        self.names = [str(i) for i in range(len(pieces))]
        if bad := crossing_pieces(pieces):
            raise ValueError(f"pieces cross white-space markers: {bad[:5]}")

    def segment(self, new: list[str]) -> list[tuple[int, str, str]]:
        """Segment chunks that the table lacks. Chunks with one marker are
        segmented side by side in one text: each starts at the only piece in
        it that starts with a marker."""
        plain = [k for k in new if k and " " not in k]
        ids = self.lib.encode(" ".join(plain)) if plain else []
        starts = [i for i, t in enumerate(ids) if self.marked[t]]
        if len(starts) == len(plain) and self.lib.decode(ids) == " ".join(plain):
            names = self.names
            spans = zip(plain, starts, [*starts[1:], len(ids)])
            found = {k: (e - s, " ".join([names[t] for t in ids[s:e]]), k) for k, s, e in spans}
        else:
            found = {}
        if rest := [k for k in new if k not in found]:
            each = self.lib.encode(rest, num_threads=1)
            for k, i, t in zip(rest, each, self.lib.decode(each)):
                found[k] = (len(i), " ".join(map(str, i)), t) if k else self.alone
        return [found[k] for k in new]

    def look_up(self, keys: list[str]) -> list[tuple[int, str, str]]:
        rows = self.rows
        new = [k for k in dict.fromkeys(keys) if k not in rows]
        if not new:
            return [rows[k] for k in keys]
        if len(rows) + len(new) > self.size:
            rows.clear()
            new = list(dict.fromkeys(keys))
        found = dict(zip(new, self.segment(new)))
        rows.update(found if max(map(len, new)) <= LONGEST else {k: v for k, v in found.items() if len(k) <= LONGEST})
        return [rows[k] if k in rows else found[k] for k in keys]

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids as text joined by a space, decoded text."""
        got = self.look_up(chunks(text or ""))
        ids = [g[1] for g in got if g[0]]
        ids.append(str(self.end))
        return sum(g[0] for g in got) + 1, " ".join(ids), " ".join([g[2] for g in got])


_tables: dict[tuple[str, int], ChunkTable] = {}


def _table(model: str, size: int) -> ChunkTable:
    """One table for each worker process, kept from task to task."""
    if (model, size) not in _tables:
        _tables[model, size] = ChunkTable(model, size)
    return _tables[model, size]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, text: str = "text", model: str | None = None, table_size: int = 150_000) -> DataFrame:
    """Add ids (array of int), decoded (string) to every row of ``df``."""
    model = model or default_model()
    keep = [c for c in df.columns if c not in ("ids", "decoded")]
    src, schema, back = exact(df.select(*[f"`{c}`" for c in keep]), keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _table(model, table_size)
        for b in batches:
            got = [rows.encode(t) for t in b[text]]
            yield b.assign(ids=[np.array(g[1].split(), np.int32) for g in got], decoded=[g[2] for g in got])

    return back(src.mapInPandas(run, schema + ", ids array<int>, decoded string"))


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, table_size: int = 150_000) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, made inside the
    task so that neither ids nor decoded texts leave it."""
    model = model or default_model()
    src, schema, back = exact(df.select(F.col(key), F.col(text)), [key])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _table(model, table_size)
        for b in batches:
            got = []
            for t in b[text]:
                n, ids, decoded = rows.encode(t)
                got.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            out = pd.DataFrame(got, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, key, b[key].array)
            yield out

    return back(src.mapInPandas(run, schema + ", n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
