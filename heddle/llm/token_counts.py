"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokenizer_files as files
from .arrow import give_back, with_columns

#: Counts of merged pre-tokens that a task remembers; it forgets all when full.
REMEMBERED = 400_000


def whole_tokens(text: str) -> list[str]:
    """Pre-tokens, in byte signs, that the merges of the tokenizer file ``text`` turn into exactly one token.

    Proven for each vocabulary string by merging it alone: being in the vocabulary isn't enough, as some strings can't be reached.
    """
    model, file = files.opened(text).model, files.parsed(text)["model"]
    suffix = file.get("end_of_word_suffix") or ""
    ends = (w[: len(w) - len(suffix)] for w in file["vocab"] if w.endswith(suffix) and len(w) > len(suffix))
    return [w for w in ends if len(model.tokenize(w)) == 1]


def as_text(sign: str) -> str | None:
    try:
        return bytes(files.TO_BYTES[c] for c in sign).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for every whole text.

    Null and empty texts have no bytes and no tokens. Special strings inside a text count one token each, as the library does.
    Pre-tokens of the proven list count one token without a merge; only the others are merged. Rows are independent, so ties,
    repeats and hot groups don't matter; of a text, only its pre-tokens are held. Columns named as the results are replaced.
    """
    session = docs.sparkSession.sparkContext
    file = files.read(tokenizer_path)
    sent = session.broadcast((file, whole_tokens(file)))
    give_back()  # the parsed file was only needed here
    size = T.StructField("n_bytes", T.LongType())
    fields = [size, T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def make():
        file, proven = sent.value
        cutter = files.Cutter(file)
        model = cutter.tokenizer.model
        whole = set(proven)
        plain_whole = {x for x in map(as_text, proven) if x is not None}
        known: dict[tuple[str, bool], int] = {}

        def merged(words: list[str], plain: bool) -> int:
            total = 0
            for word in words:
                n = known.get((word, plain))
                if n is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    n = known[word, plain] = len(model.tokenize(files.signs(word) if plain else word))
                total += n
            return total

        def count(value: str) -> int:
            total = 0
            for words, plain, special in cutter.segments(value):
                if special is not None:
                    total += 1
                    continue
                one = plain_whole if plain else whole
                rest = [w for w in words if w not in one]
                total += len(words) - len(rest) + merged(rest, plain)
            return total

        def work(texts: list[str]) -> list[list]:
            counts = [count(x) for x in texts]
            return [[len(x.encode("utf-8", "replace")) for x in texts], counts, [n > limit for n in counts]]

        return work

    return with_columns(docs, text, fields, make, keep)


def summary(counted: DataFrame) -> DataFrame:
    """Documents, bytes, tokens and documents over the limit, of all rows."""
    return counted.agg(F.count("*").alias("documents"), F.sum("n_bytes").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("over_limit").cast("long")).alias("over_limit"))
