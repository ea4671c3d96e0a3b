"""Token counts of whole texts: lengths alone leave the task, long texts are cut where no piece can cross."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Vocabulary, tokens over which a document is over the limit, bytes of one call, and characters of a part of a text.
MODEL, LIMIT = "piece_bpe_32k.model", 4096
CALL, PART = 1 << 18, 1 << 15
_SPACE = "▁"


class Splitter:
    """Cuts texts where no piece of the vocabulary can stand on both sides, so that the parts' counts add up.

    Merges never join two characters that stand next to each other in no piece. The library puts a space before every
    text it gets: a part that begins with a space loses that one, and any other part counts one token too many, which
    is right only if no piece joins the space to its first character.
    """

    def __init__(self, pieces: list[str]):
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def parted(self, a: str, b: str) -> bool:
        """Whether a text may be cut between the characters ``a`` and ``b``."""
        a, b = (_SPACE if x == " " else x for x in (a, b))
        return a + b not in self.joined and (b == _SPACE or _SPACE + b not in self.joined)

    def parts(self, text: str, size: int = PART) -> Iterator[tuple[str, int]]:
        """(part, tokens that the library adds to it), of at least ``size`` characters up to the next safe place."""
        begin, extra = 0, 0
        while True:
            at = begin + size
            while at < len(text) - 1 and not self.parted(text[at - 1], text[at]):
                at += 1
            if at >= len(text) - 1:
                yield text[begin:], extra
                return
            yield text[begin:at], extra
            spaced = text[at] in (" ", _SPACE)
            begin, extra = (at + 1, 0) if spaced else (at, 1)


@lru_cache(maxsize=2)
def _library(path: str) -> tuple:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return model, Splitter([model.id_to_piece(i) for i in range(model.get_piece_size())])


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def lengths(texts: list[str], path: str, call: int = CALL, size: int = PART) -> list[int]:
    """Tokens of each text. A call to the library gets parts of ``call`` bytes or a little more, however many texts that is."""
    model, splitter = _library(path)
    out, held, room = [0] * len(texts), [], 0

    def told() -> None:
        for (n, extra), ids in zip([h[1:] for h in held], model.encode([h[0] for h in held], num_threads=1), strict=True):
            out[n] += len(ids) - extra
        held.clear()

    for n, text in enumerate(texts):
        for part, extra in splitter.parts(text, size) if len(text) > size else ((text, 0),):
            held.append((part, n, extra))
            room += len(part.encode("utf-8", "surrogatepass"))
            if room >= call:
                told()
                room = 0
    told()
    return out


def counts(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document (doc_id, text), counted as sentencepiece gives them.

    Whole texts, without begin or end tokens; strings like ``</s>`` in a text are ordinary characters, as is the
    library's default. Null and empty texts have 0 bytes and tokens; repeated rows and null ids each keep their row;
    other columns are ignored; an empty table gives no rows. Nothing is shuffled, and only the four columns leave a task. Each executor
    reads the vocabulary at ``path``, that of the installed package by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = path or model_path()
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            size = pc.cast(pc.binary_length(texts), pa.int64())
            begin = 0
            while begin < batch.num_rows:  # a few megabytes of text at a time become Python strings
                end, room = begin, 0
                while end < batch.num_rows and room < 16 * CALL:
                    room += size[end].as_py()
                    end += 1
                n = pa.array(lengths(texts[begin:end].to_pylist(), own), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[begin:end], size[begin:end], n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
                begin = end

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
