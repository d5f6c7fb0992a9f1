r"""Text cleaning and tokenising as column expressions.

Character classes are spelt out because ``\w`` and ``\s`` mean different sets
in different regex engines: a word character is a letter, a number or ``_``, and
white space is what Unicode calls white space.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.functions.fixed_values import CUSTOM_STOPWORDS, ENGLISH_STOPWORDS, FIELD_SEPARATOR, NOUN_RULES
from tidemark.functions.arrow import coded_pieces, tallied
from tidemark.sizes import fits_broadcast, write_once

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1C-\x20\x{85}\p{Z}"


def strip_space(text: Column) -> Column:
    """Trim all white space, not only blanks.

    A match at the end may only start where a run of white space starts, so a
    long run inside the text is looked at once, not from each of its places.
    """
    return F.regexp_replace(text, f"^[{SPACE}]+|(?<![{SPACE}])[{SPACE}]+$", "")


def clean_text(text: Column, mode: str = "regex", null_text: str = "") -> Column:
    """Prepare a field for a text encoder.

    ``regex`` unescapes the three entities and puts a blank between words and
    punctuation; ``literal`` treats the same patterns as plain text, so only
    ``&lt;``, ``&gt;`` and the exact text ``&amp;?`` change.
    """
    text = F.coalesce(text, F.lit(null_text))
    if mode == "regex":
        text = F.regexp_replace(text, "&amp;?", "and")
        text = F.replace(text, F.lit("&lt;"), F.lit("<"))
        text = F.replace(text, F.lit("&gt;"), F.lit(">"))
        # Only the border between a word and punctuation changes, so one
        # character on each side is enough to find it.
        text = F.regexp_replace(text, f"([{WORD}])([^{WORD} ])", "$1 $2")
        text = F.regexp_replace(text, f"([^{WORD} ])([{WORD}])", "$1 $2")
    elif mode == "literal":
        for old, new in (("&amp;?", "and"), ("&lt;", "<"), ("&gt;", ">")):
            text = F.replace(text, F.lit(old), F.lit(new))
    else:
        raise ValueError(f"unknown clean mode {mode!r}")
    return strip_space(text)


def join_fields(body: Column, selftext: Column, title: Column) -> Column:
    """The three text fields of a post as one string; a missing field is empty."""
    return F.concat_ws(FIELD_SEPARATOR, *(F.coalesce(c, F.lit("")) for c in (body, selftext, title)))


def token_source(body: Column, selftext: Column, title: Column, null_text: str = "") -> Column:
    """Text to tokenise: a submission's text and title, else a comment's body."""
    return (
        F.when(
            selftext.isNotNull() | title.isNotNull(),
            F.concat_ws(" ", F.coalesce(selftext, F.lit(null_text)), F.coalesce(title, F.lit(null_text))),
        )
        .when(body.isNotNull(), body)
        .otherwise(F.lit(""))
    )


def raw_words(text: Column) -> Column:
    """Lower-cased pieces between white space, without punctuation.

    Punctuation goes in one pass over the whole text; it contains no white
    space, so the pieces are the same as when each is stripped by itself.
    """
    return F.split(F.regexp_replace(F.lower(text), f"[^{WORD}{SPACE}]", ""), f"[{SPACE}]+")


def default_stopwords() -> list[str]:
    """Spark ML's English list and the custom additions."""
    return sorted({*ENGLISH_STOPWORDS, *CUSTOM_STOPWORDS})


def _sql_strings(values: Iterable[str]) -> str:
    """A list for one SQL text, much quicker to build than a literal column each."""
    escaped = (value.replace("\\", "\\\\").replace("'", "\\'") for value in values)
    return ", ".join(f"'{value}'" for value in escaped)


def keep_word(word: Column, stopwords: Iterable[str] = ()) -> Column:
    """Longer than one character and no stop word."""
    keep = F.length(word) > 1
    stopwords = list(stopwords)
    return keep & ~word.isin(stopwords) if stopwords else keep


def word_array(text: Column, stopwords: Iterable[str] = ()) -> Column:
    """The kept words of a text, in order."""
    stopwords = list(stopwords)
    return F.filter(raw_words(text), lambda word: keep_word(word, stopwords))


def explode_words(df: DataFrame, text: str, keep: Iterable[str], stopwords: Iterable[str] = ()) -> DataFrame:
    """One row per kept word, with the columns ``keep``.

    The word tests run after the explode, where they are compiled, instead of
    inside a lambda, where they would be interpreted.
    """
    words = df.select(*keep, F.explode(raw_words(F.col(text))).alias("word")).where(keep_word(F.col("word")))
    stopwords = list(stopwords)
    return words.where(F.expr(f"word NOT IN ({_sql_strings(stopwords)})")) if stopwords else words


def tally_words(df: DataFrame, keep: Iterable[str], words: str = "words", lead: str | None = None) -> DataFrame:
    """One row per different word of each row's array, with its count ``tf``.

    A document's words are all in one row, so counting needs no shuffle: in the
    sorted array a word's count is the distance between two places where the
    word changes.  ``lead`` names a column that is true for one word of each row.
    """
    keep = list(keep)
    # No filter on the array: it would be pushed below the projection that makes
    # the array, which would then be made twice.
    ordered = df.select(*keep, F.array_sort(words).alias("_w"))
    places = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1)))
    counted = F.transform(
        "_at",
        lambda at, k: F.struct(
            F.get("_w", at).alias("word"),
            (F.coalesce(F.get("_at", k + 1), F.size("_w")) - at).alias("tf"),
            *([(k == 0).alias(lead)] if lead else []),
        ),
    )
    return ordered.withColumn("_at", starts).select(*keep, F.inline(counted))


#: Rows whose words are counted at once: by row, and together.
TALLY_ROWS, GROUP_ROWS = 1024, 4096


def tally_pieces(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """As :func:`tally_words` of the lower-case :func:`pieces` of a text, counted by Arrow: ``keep``, ``word`` and ``tf``."""
    keep = list(keep)
    ready = df.select(*keep, F.lower(text).alias("_text"))

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, TALLY_ROWS) for at in range(0, batch.num_rows, TALLY_ROWS)):
                rows, codes, words = coded_pieces(part.column("_text"))
                (row, code), times = tallied(rows, codes, max(len(words), 1))
                columns = [*(part.column(name).take(pa.array(row)) for name in keep), words.take(pa.array(code)), pa.array(times)]
                made = pa.RecordBatch.from_arrays(columns, [*keep, "word", "tf"])
                yield made.filter(pc.not_equal(made["word"], ""))

    counted = StructType([*(ready.schema[name] for name in keep), StructField("word", StringType()), StructField("tf", IntegerType())])
    return ready.mapInArrow(tally, counted)


def pieces_by_word(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows of :func:`tally_pieces` with those of a word side by side: ``word`` and arrays ``key`` and ``tf``.

    A row holds what up to :data:`GROUP_ROWS` texts have of a word, so a lookup by word meets far fewer rows.
    """
    ready = df.select(key, F.lower(text).alias("_text"))

    def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, GROUP_ROWS) for at in range(0, batch.num_rows, GROUP_ROWS)):
                rows, codes, words = coded_pieces(part.column("_text"))
                (code, row), times = tallied(codes, rows, part.num_rows)
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                ends = pa.array(np.append(starts, len(code)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, values) for values in (part.column(key).take(pa.array(row)), pa.array(times)))
                made = pa.RecordBatch.from_arrays([words.take(pa.array(code[starts])), *lists], ["word", key, "tf"])
                yield made.filter(pc.not_equal(made["word"], ""))

    keys = StructField(key, ArrayType(ready.schema[key].dataType))
    return ready.mapInArrow(group, StructType([StructField("word", StringType()), keys, StructField("tf", ArrayType(IntegerType()))]))


def drop_stopwords(words: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Anti join with a stop-word table ``(word)``."""
    return words.join(stopwords.select("word"), "word", "left_anti")


def lemmatise(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace each word by its lemma from a table ``(surface, lemma)``, if it has one."""
    table = lemmas.select(F.col("surface").alias("word"), "lemma")
    return words.join(table, "word", "left").withColumn("word", F.coalesce("lemma", "word")).select(*words.columns)


def lemmatise_arrays(
    docs: DataFrame, lemmas: DataFrame, keys: Iterable[str], words: str = "words", folder: str | None = None
) -> DataFrame:
    """Replace the words of each row's array by their lemmas, in place; columns ``keys`` and ``words``.

    There is a row per input row, also where rows agree in all keys.  The lemma table
    ``(surface, lemma)`` may be of any size; of several lemmas of a word the first in order
    counts.  With a ``folder`` that all executors share the table is stored there and measured;
    if it fits, every task gets it and replaces words where they stand, without a shuffle.
    Otherwise it is joined to the single words; rows equal in keys and words are one row with
    a count on the way.
    """
    keys = list(keys)
    table = lemmas.groupBy(F.col("surface").alias("_word")).agg(F.min("lemma").alias("_lemma"))
    if folder is not None:
        table = write_once(table.dropna(), folder, "lemmas")
        if fits_broadcast(table):
            return _replaced(docs.select(*keys, F.col(words).alias(words)), table.toArrow(), words)
    different = docs.select(*keys, F.coalesce(words, F.array()).alias("_list")).groupBy(*keys, "_list").agg(F.count("*").alias("_copies"))
    # Keys and hash name a row of these; the hash is made before the words are dealt out.
    named = different.select(*keys, "_copies", F.xxhash64("_list").alias("_row"), "_list")
    spelt = named.select(*keys, "_copies", "_row", F.posexplode_outer("_list").alias("_at", "_word"))
    joined = spelt.join(table, "_word", "left")
    word = F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("_lemma", "_word").alias("word")))
    ordered = F.array_sort(F.collect_list(word))
    back = joined.groupBy(*keys, "_row", "_copies").agg(F.transform(ordered, lambda item: item["word"]).alias(words))
    each = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    return back.select(*keys, words, each).drop("_copy")


def _replaced(docs: DataFrame, table: pa.Table, words: str) -> DataFrame:
    """``docs`` with the words of each row's array replaced by a table ``(_word, _lemma)`` sent to all tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).combine_chunks() for c in ("_word", "_lemma")))

    def replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces, found = shared.value
        for batch in batches:
            lists = batch.column(words)
            spelt = lists.flatten()
            lemma = found.take(pc.index_in(spelt, value_set=surfaces))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            made = pa.ListArray.from_arrays(ends, pc.coalesce(lemma, spelt))
            yield pa.RecordBatch.from_arrays([made if name == words else batch.column(name) for name in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(replace, docs.schema)


def lemma_candidates(word: Column, rules: Sequence[tuple[str, str]], rounds: int) -> Column:
    """All forms that rules make of a word: an array of (round, place of the rule, form).

    A rule replaces a suffix by an ending.  Round 0 is the word itself, each further
    round applies the rules to what the round before has made.
    """
    kind = "array<struct<round:int,rule:int,form:string>>"

    def made(item: Column, at: int) -> Column:
        form = item["form"]
        found = [
            F.when(
                F.endswith(form, F.lit(suffix)) & (F.length(form) > len(suffix)),
                F.struct(
                    F.lit(at).alias("round"),
                    F.lit(place).alias("rule"),
                    F.concat(F.left(form, F.length(form) - len(suffix)), F.lit(ending)).alias("form"),
                ),
            )
            for place, (suffix, ending) in enumerate(rules)
        ]
        return F.filter(F.array(*found), lambda item: item.isNotNull()).cast(kind)

    last = F.array(F.struct(F.lit(0).alias("round"), F.lit(-1).alias("rule"), word.alias("form"))).cast(kind)
    parts = [last]
    for at in range(1, rounds + 1):
        # A function of one argument: a second one would be the place in the array.
        last = F.flatten(F.transform(last, partial(lambda at, item: made(item, at), at)))
        parts.append(last)
    return F.concat(*parts)


def lemmas_by_rules(
    words: DataFrame,
    dictionary: DataFrame,
    exceptions: DataFrame | None = None,
    rules: Sequence[tuple[str, str]] = tuple(NOUN_RULES),
    rounds: int = 2,
    word: str = "word",
) -> DataFrame:
    """A lemma table ``(surface, lemma)`` for the words of a corpus, without a list of all forms.

    ``words`` and ``dictionary`` hold a column ``word``.  A word's forms are itself and
    what the suffix rules make of it; those in the dictionary are kept with a semi join.
    The earliest round with any counts, and in it the shortest form, then the earliest
    rule.  ``exceptions`` ``(surface, lemma)`` come before all rules, if the dictionary
    has their lemma.  Words without a lemma, or that are their own, are left out.
    """
    spelt = words.select(F.col(word).alias("surface")).where(F.col("surface").isNotNull()).distinct()
    made = spelt.select("surface", F.inline(lemma_candidates(F.col("surface"), rules, rounds)))
    if exceptions is not None:
        irregular = exceptions.select("surface", F.lit(-1).alias("round"), F.lit(-1).alias("rule"), F.col("lemma").alias("form"))
        made = made.unionByName(irregular.join(spelt, "surface", "left_semi"))
    known = dictionary.select(F.col(word).alias("form")).distinct()
    best = F.struct("round", F.length("form").alias("length"), "rule", "form")
    found = made.join(known, "form", "left_semi").groupBy("surface").agg(F.min(best).alias("_best"))
    return found.select("surface", F.col("_best.form").alias("lemma")).where(F.col("surface") != F.col("lemma"))


def pieces(text: Column) -> Column:
    """The text's pieces between white space, none of them empty."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda piece: piece != "")


def last_items(items: Column, n: int) -> Column:
    """The last ``n`` items of an array, all of them if there are fewer."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def last_tokens(text: Column, n: int) -> Column:
    """The last ``n`` white-space tokens of a text, joined by blanks."""
    return F.array_join(last_items(pieces(text), n), " ")
