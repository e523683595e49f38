"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table

#: Pieces of up to so many characters are looked up before they are encoded; the table is emptied at so many entries.
SHORT, KNOWN = 48, 400_000
#: A piece of more characters is also cut before a comma and the like that follows a letter.
LONG = 1 << 14

#: Letters that every version of the models' tables knows as such and that stay letters when lower-cased and composed: not İ, whose lower
#: case ends in a combining mark.
_LETTER = r"a-zA-Z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F\u0391-\u03A1\u03A3-\u03C9\u0410-\u044F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3"
_STOP = re.compile(rf"(?<=[{_LETTER}])(?=[,;!?，、。；！？](?:[^\W_]|\s))")


def pieces(text: str) -> Iterator[str]:
    """Cut text before each single space that follows other than white space and precedes a letter.

    No token, contraction, composed character or special string of the .json models spans such a place, and a
    space keeps the letter run it stands before; so counts of the pieces add up to that of the text. A piece of over LONG characters
    (text without such spaces) is cut too between a letter of _LETTER and a mark that a letter, digit or space follows: the models part
    letters from marks, and none of these marks composes or belongs to a special string; letters whose lower case ends in a mark, or that
    a model's tables may not know, are no such place. What has neither, such as one run of
    digits, is one piece, for a token may span any place of it.
    """
    start, at, last = 0, text.find(" ", 1), len(text) - 1
    while 0 < at < last:
        if text[at + 1].isalpha() and not text[at - 1].isspace():
            yield from _shorter(text, start, at)
            start = at
        at = text.find(" ", at + 1)
    yield from _shorter(text, start, len(text))


def _shorter(text: str, start: int, stop: int) -> Iterator[str]:
    if stop - start > LONG:
        for m in _STOP.finditer(text, start + 1, stop):
            yield text[start : m.start()]
            start = m.start()
    yield text[start:stop]


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit.

    tokenizer is a name in the public tokenizer folder or a path every executor can open. Texts for a .json model are
    split at safe boundaries, so a long text is never one call; short pieces met before are looked up, the others
    gathered into encoder calls of about batch_bytes. A .model is fed whole texts. Null text counts as empty (0
    tokens); a null id stays null; repeated rows give repeated rows; an empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        encode = _load(tokenizer if os.path.sep in tokenizer else default_path(tokenizer))
        split = not tokenizer.endswith(".model")
        known: dict[str, int] = {}
        for batch in batches:
            text = batch.column(1)
            size = pc.binary_length(pc.cast(pc.fill_null(text, ""), pa.binary())).cast(pa.int64())
            total = [0] * len(text)
            waiting: dict[str, list[int]] = {}
            held = 0

            def flush():
                if len(known) > KNOWN:
                    known.clear()
                for (piece, owners), n in zip(waiting.items(), encode(list(waiting)) if waiting else ()):
                    if len(piece) <= SHORT:
                        known[piece] = n
                    for i in owners:
                        total[i] += n
                waiting.clear()

            for i, t in enumerate(text):
                t = t.as_py()
                if not t:
                    continue
                n = 0
                for piece in pieces(t) if split else (t,):
                    found = known.get(piece)
                    if found is not None:
                        n += found
                    elif piece in waiting:
                        waiting[piece].append(i)
                    else:
                        waiting[piece] = [i]
                        held += len(piece)
                        if held >= batch_bytes:
                            flush()
                            held = 0
                total[i] += n
            flush()
            tokens = pa.array(total, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens, pc.greater(tokens, max_tokens)], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(count), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
