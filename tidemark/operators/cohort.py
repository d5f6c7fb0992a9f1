"""Author timelines: membership cuts, companions, per-author documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import ENCODER_TOKENS, POST_SEPARATOR
from tidemark.functions.text import last_tokens, pieces
from tidemark.sizes import lookup_join

# Width of the time slices an author's posts are first joined in.
SLICE_SECONDS = 3_600


def posts_of_authors(posts: DataFrame, authors: DataFrame, author: str = "author") -> DataFrame:
    """Posts whose author is in a one-column author table.

    No hint: the size of a sample or of a stored list is known to Spark, which
    broadcasts it below its threshold and shuffles both sides above.
    """
    return posts.join(authors.select(author), author, "left_semi")


def label_cohorts(cohorts: dict[str, DataFrame], label: str = "class") -> DataFrame:
    """Union of the cohorts, each row marked with its cohort's name."""
    marked = [df.withColumn(label, F.lit(name)) for name, df in cohorts.items()]
    together = marked[0]
    for df in marked[1:]:
        together = together.unionByName(df, allowMissingColumns=True)
    return together


def _in_listed(posts: DataFrame, communities: Sequence[str] | DataFrame, community: str) -> DataFrame:
    """Posts in listed communities, with the list position as ``_priority``.

    A table ``(community, priority)`` may stand in for the list.
    """
    if isinstance(communities, DataFrame):
        ranks = communities.select(F.col("community").alias(community), F.col("priority").alias("_priority"))
        return posts.join(ranks, community)
    listed = F.array(*(F.lit(name) for name in communities))
    return posts.where(F.col(community).isin(list(communities))).withColumn(
        "_priority", F.array_position(listed, F.col(community))
    )


def _keep_before(posts: DataFrame, cuts: DataFrame, by: str, order: str, folder: str | None) -> DataFrame:
    kept = lookup_join(posts, cuts, [by], salt_by=[order], folder=folder).where(F.col("_cut").isNull() | (F.col(order) < F.col("_cut")))
    return kept.select(*posts.columns)


def cut_by_time(
    posts: DataFrame,
    communities: Sequence[str] | DataFrame,
    author: str = "author",
    community: str = "subreddit",
    at: str = "created_utc",
    folder: str | None = None,
) -> DataFrame:
    """Keep an author's posts strictly before the first one in a listed community.

    Authors without such a post keep everything.  The cut is an aggregate over
    the listed posts only, so no author's whole timeline meets in one task.
    ``folder`` stores and measures it first, see :func:`tidemark.sizes.lookup_join`.
    """
    cuts = _in_listed(posts.select(author, community, at), communities, community)
    return _keep_before(posts, cuts.groupBy(author).agg(F.min(at).alias("_cut")), author, at, folder)


def cut_by_position(
    posts: DataFrame,
    communities: Sequence[str] | DataFrame,
    file: str = "file",
    community: str = "subreddit",
    position: str = "pos",
    folder: str | None = None,
) -> DataFrame:
    """Like :func:`cut_by_time`, per file and by line number instead of time."""
    cuts = _in_listed(posts.select(file, community, position), communities, community)
    return _keep_before(posts, cuts.groupBy(file).agg(F.min(position).alias("_cut")), file, position, folder)


def cut_by_priority(
    posts: DataFrame,
    communities: Sequence[str] | DataFrame,
    author: str = "author",
    community: str = "subreddit",
    position: str = "pos",
    folder: str | None = None,
) -> DataFrame:
    """Cut at the first post in the author's highest-listed community.

    ``position`` orders an author's posts over all files.

    Of the listed communities an author posted in, the one listed first decides,
    even if the author joined a later-listed one before it.
    """
    listed = _in_listed(posts.select(author, community, position), communities, community)
    first = F.min(F.struct("_priority", F.col(position).alias("_cut")))
    cuts = listed.groupBy(author).agg(first.alias("_first")).select(author, "_first._cut")
    return _keep_before(posts, cuts, author, position, folder)


def companion_first_match(
    authors: DataFrame,
    companions: DataFrame,
    author: str = "author",
    priority: str = "priority",
    folder: str | None = None,
) -> DataFrame:
    """Companion rows of the given authors, each author's from one source only.

    ``companions`` holds posts of several sources with the source's priority;
    an author's rows come from the lowest priority that has any.
    """
    chosen = (
        companions.select(author, priority)
        .groupBy(author)
        .agg(F.min(priority).alias("_chosen"))
        .join(authors.select(author).distinct(), author, "left_semi")
    )
    matched = lookup_join(companions, chosen, [author], "inner", folder=folder)
    return matched.where(F.col(priority) == F.col("_chosen")).select(*companions.columns)


def with_companions(
    posts: DataFrame,
    companions: DataFrame,
    author: str = "author",
    priority: str = "priority",
    folder: str | None = None,
) -> DataFrame:
    """Posts together with their authors' companion rows; authors without any stay."""
    matched = companion_first_match(posts, companions, author, priority, folder)
    return posts.unionByName(matched, allowMissingColumns=True)


def time_slice(at: Column, seconds: int = SLICE_SECONDS) -> Column:
    """The slice of time, ``seconds`` wide, that epoch seconds or a timestamp falls in."""
    return F.floor(at.cast("timestamp").cast("long") / seconds)


def author_slices(
    posts: DataFrame,
    order: Sequence[str],
    slice_of: Column,
    author: str = "author",
    text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Each author's document in parts, one row per ``slice`` of its order.

    ``slice_of`` is a coarse, non-decreasing function of the order, such as
    :func:`time_slice`.  The parts are bounded by what is posted in one slice,
    so this form also suits authors whose whole document is too long for a row.
    ``keep`` are columns constant per author.
    """
    ordered = ", ".join(f"`{c}`" for c in order)
    joined = F.expr(f"listagg(`{text}`, '{POST_SEPARATOR}') within group (order by {ordered})")
    named = posts.where(F.col(author).isNotNull()).withColumn("slice", slice_of)
    return named.groupBy(author, *keep, "slice").agg(joined.alias(text))


def author_text(
    posts: DataFrame,
    order: Sequence[str],
    slice_of: Column,
    author: str = "author",
    text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One document per author: the posts' texts in the given order.

    Built from :func:`author_slices`, so a very active author is spread over
    many tasks, but the finished parts meet in one: a document is one row, bounded
    by one Spark string (2 GB).  Jobs use :func:`author_tail`, which is bounded by
    what an encoder reads, or the slices.
    """
    parts = author_slices(posts, order, slice_of, author, text, keep)
    whole = F.expr(f"listagg(`{text}`, '{POST_SEPARATOR}') within group (order by slice)")
    return parts.groupBy(author, *keep).agg(whole.alias(text))


def author_tail(
    posts: DataFrame,
    order: Sequence[str],
    slice_of: Column,
    n: int = ENCODER_TOKENS,
    author: str = "author",
    text: str = "text",
    keep: Sequence[str] = (),
    folder: str | None = None,
) -> DataFrame:
    """The last ``n`` white-space tokens of each author's document.

    Equal to taking the last tokens of :func:`author_text`, but slices with
    ``n`` tokens after them can never be part of the result and are dropped
    first.  What is joined per author is ``n`` tokens and one slice at most,
    however much the author wrote.
    """
    later = Window.partitionBy(author).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sliced = posts.where(F.col(author).isNotNull()).select(author, *keep, *order, text, slice_of.alias("_slice"))
    needed = (
        sliced.groupBy(author, "_slice")
        .agg(F.sum(F.size(pieces(F.col(text)))).alias("_tokens"))
        .withColumn("_later", F.coalesce(F.sum("_tokens").over(later), F.lit(0)))
        .where(F.col("_later") < n)
        .groupBy(author)
        .agg(F.min("_slice").alias("_from"))
    )
    near = lookup_join(sliced, needed, [author], "inner", salt_by=order, folder=folder).where(F.col("_slice") >= F.col("_from"))
    tail = author_text(near, order, F.col("_slice"), author, text, keep)
    return tail.withColumn(text, last_tokens(F.col(text), n))
