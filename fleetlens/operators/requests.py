"""Request-log shaping.

Request files hold cases like::

    # Title
    GET index-a,index-b/_search?size=10
    {"query": {"match_all": {}}}

Each row holds a whole file's text or, read from files by lines, one case of
it.  Splitting, title / method / path / body extraction and JSON
validation are string functions on that row; files never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.scalars import drop_blank_edge_lines, format_count, is_msearch_path, strip_ws, target_names
from fleetlens.operators.joins import lookup_join
from fleetlens.session import write_shared

# Per-case error texts.
ERR_NO_METHOD = "missing method line"
ERR_BAD_METHOD = "bad method line"
ERR_BAD_JSON = "invalid JSON body"
ERR_PREAMBLE = "content before the first title"

# Fixed value: a request line is a method word and a path.
REQUEST_LINE = r"^([A-Za-z]+)\s+(.+)$"

_WS = r"[ \t\f\u000B]"

#: Rows of cases that a task sorts: some 200 bytes each in its memory.
TASK_ROWS = 500_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file_id, part, title, line) of a task, in file order, as pieces of
    cases: file_id, part, ``own`` (titles of the part so far) and text."""
    names = ["file_id", "part", "own", "text"]
    last, own, held = None, 0, []  # part and number of the piece that is open, and its texts so far

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*last, own, "\n".join(held)], (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        files, parts = b.column(0), b.column(1)
        ends = np.union1d(*[pc.run_end_encode(c).run_ends.to_numpy() for c in (files, parts)])
        begin = np.append(0, ends[:-1])  # where a part begins, at the earliest in this batch
        title = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        here = (files[0].as_py(), parts[0].as_py())
        goes_on = here == last
        if last is not None and not (goes_on and not title[0]):
            yield closed()
            held = []
        count = np.cumsum(title)
        number = count - np.repeat((count - title)[begin], ends - begin)
        if goes_on:
            number[: ends[0]] += own
        fresh = title.copy()
        fresh[begin] = True
        first = np.flatnonzero(fresh)
        offsets = pa.array(np.append(first, b.num_rows), pa.int32())
        text = pc.binary_join(pa.ListArray.from_arrays(offsets, b.column(3)), "\n")
        if held:  # the open piece goes on in the first one
            text = pa.concat_arrays([pa.array(["\n".join([*held, text[0].as_py()])] if len(text) > 1 else [text[0].as_py()], pa.string()), text.slice(1)])
        held = [*(held if len(text) == 1 else []), text[-1].as_py()]
        last, own = (files[-1].as_py(), parts[-1].as_py()), int(number[-1])
        done = first[:-1]
        yield pa.RecordBatch.from_arrays([files.take(pa.array(done)), parts.take(pa.array(done)), pa.array(number[done]), text.slice(0, len(done))], names=names)
    if last is not None:
        yield closed()


def read_request_logs(spark: SparkSession, path: str) -> DataFrame:
    """Cases of the request files below ``path``: ``file_id`` (the file's path),
    ``number`` (of the case in its file; 0 before the first title) and ``text``
    (S12).

    Files are read by lines, so a large one is many tasks.  The lines of a part
    of a file come to one task in their order, which puts them together without
    a shuffle; a case is one request, which fits into a task.  Titles are
    numbered in two levels: inside a part, and over the parts of a file by sums
    of their titles.  Only a part's first and last piece, which its neighbours
    may go on with, are shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("part"),
        F.col("value").rlike(rf"^{_WS}*#").alias("title"),
        F.col("value").alias("line"),
    )
    pieces = write_shared(lines.mapInArrow(_pieces, "file_id string, part long, own long, text string"), "log-pieces")
    titles = pieces.groupBy("file_id", "part").agg(F.max("own").alias("titles"))
    earlier = Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = titles.select(F.struct("file_id", "part").alias("place"), "titles", F.coalesce(F.sum("titles").over(earlier), F.lit(0)).alias("before"))
    numbered = lookup_join(pieces.withColumn("place", F.struct("file_id", "part")), before, "place", "inner")
    numbered = numbered.withColumn("number", (F.col("before") + F.col("own")).cast("int"))
    edge = (F.col("own") == 0) | (F.col("own") == F.col("titles"))
    torn = numbered.where(edge).groupBy("file_id", "number").agg(F.array_sort(F.collect_list(F.struct("part", "own", "text"))).alias("pieces"))
    joined = torn.select("file_id", "number", F.array_join(F.col("pieces.text"), "\n").alias("text"))
    return numbered.where(~edge).select("file_id", "number", "text").unionByName(joined)


def parse_requests(files: DataFrame, id_col: str = "file_id", text_col: str = "text", number_col: str | None = None) -> DataFrame:
    """Split request files into cases (R1) and flag bad ones (R2).

    ``number_col`` says that a row is not a file but cases out of one, the
    first of which has that number (see :func:`read_request_logs`).

    Output: ``file_id, seq, title, method, path, body_raw, body_sent, body_is_ndjson,
    body_valid, error``.  A bad case gets an ``error`` and keeps its place in
    the numbering; good cases are ``error IS NULL``.
    """
    text = F.replace(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    starts_with_title = text.rlike(rf"^{_WS}*#")

    # Each block's base strings are computed once, inside the generator's
    # input: later filters (e.g. error IS NULL) cannot be pushed below the
    # Generate, so the regular expressions are never re-evaluated per use.
    def pieces(b):
        # title line; the first non-blank line after it is the method line
        return F.struct(
            b.rlike(rf"^{_WS}*#").alias("is_title"),
            (F.length(strip_ws(b)) == 0).alias("blank"),
            F.substring_index(b, "\n", 1).alias("first_line"),
            F.regexp_extract(b, rf"(?s)^[^\n]*\n(?:{_WS}*\n)*+(.*)", 1).alias("rest"),
        )

    def with_request_line(x):
        # the lines after the method line, without leading / trailing blank lines, are the body
        line = strip_ws(F.substring_index(x["rest"], "\n", 1))
        body = drop_blank_edge_lines(x["rest"], skip_first_line=True)
        m = F.regexp_extract(line, REQUEST_LINE, 1)
        p = strip_ws(F.regexp_extract(line, REQUEST_LINE, 2))
        return F.struct(
            *[x[f].alias(f) for f in ("is_title", "blank", "first_line")],
            line.alias("method_line"), body.alias("body"), F.upper(m).alias("method"), p.alias("path"),
        )

    def with_body_checks(x):
        msearch = is_msearch_path(x["path"])
        has_body = strip_ws(x["body"]) != ""
        # exactly one complete JSON value: wrapping it in brackets must give a
        # one-element array (rejects truncated bodies and trailing text), and
        # the strict parser must accept it (rejects single quotes)
        one = F.coalesce(F.json_array_length(F.concat(F.lit("["), x["body"], F.lit("]"))) == 1, F.lit(False))
        valid = F.when(has_body & ~msearch, F.when(one, F.try_parse_json(x["body"]).isNotNull()).otherwise(F.lit(False)))
        return F.struct(
            *[x[f].alias(f) for f in ("is_title", "blank", "first_line", "method_line", "method", "path")],
            F.when(has_body, x["body"]).otherwise(F.lit("")).alias("body"),
            msearch.alias("msearch"),
            valid.alias("valid"),
        )

    # Blocks become rows with one generator; each further step materialises
    # its fields through inline(array(struct)) -- generated code, evaluated
    # once per block, and a barrier that later filters are not pushed below.
    exploded = files.select(
        F.col(id_col).alias("file_id"),
        starts_with_title.alias("__first_is_title"),
        (F.col(number_col) if number_col else F.lit(1)).alias("__number"),
        # a block starts at every line whose first visible character is '#';
        # splitting on the newline before it tests the lookahead at newlines only
        F.posexplode(F.split(text, rf"\n(?={_WS}*#)", -1)).alias("__pos", "__block"),
    )
    keep = ["file_id", "__first_is_title", "__number", "__pos"]
    step1 = exploded.select(*keep, F.inline(F.array(pieces(F.col("__block")))))
    step2 = step1.select(*keep, F.inline(F.array(with_request_line(F.struct(*[F.col(c) for c in ("is_title", "blank", "first_line", "rest")])))))
    step3 = step2.select(
        *keep,
        F.inline(F.array(with_body_checks(F.struct(*[F.col(c) for c in ("is_title", "blank", "first_line", "method_line", "body", "method", "path")])))),
    )
    exploded = step3.select(*keep, F.struct(*[c for c in step3.columns if c not in keep]).alias("__b"))
    seq = (F.col("__pos") + F.when(F.col("__first_is_title"), F.col("__number")).otherwise(0)).cast("int")
    raw_title = strip_ws(F.ltrim(strip_ws(F.col("__b.first_line")), F.lit("#")))
    title = F.when(raw_title == "", F.concat(F.lit("Query "), seq.cast("string"))).otherwise(raw_title)

    cases = exploded.select(
        "file_id",
        seq.alias("seq"),
        F.col("__b.is_title").alias("__is_title"),
        F.col("__b.blank").alias("__blank"),
        title.alias("title"),
        F.col("__b.method_line").alias("__method_line"),
        F.col("__b.method").alias("__method"),
        F.col("__b.path").alias("__path"),
        F.col("__b.body").alias("__body"),
        F.col("__b.msearch").alias("__msearch"),
        F.col("__b.valid").alias("__valid"),
    )
    msearch = F.col("__msearch")
    has_body = F.col("__body") != ""
    ndjson = msearch & has_body
    valid_json = F.col("__valid")
    error = (
        F.when(F.col("__method_line") == "", F.lit(ERR_NO_METHOD))
        .when(F.col("__method") == "", F.lit(ERR_BAD_METHOD))
        .when(has_body & ~msearch & ~F.coalesce(valid_json, F.lit(False)), F.lit(ERR_BAD_JSON))
    )
    ok_method = (F.col("__method_line") != "") & (F.col("__method") != "")
    title_block = F.col("__is_title")
    # one pass over the blocks: title blocks are cases, a non-blank preamble
    # is an error row with seq 0, a blank preamble is dropped
    kept = cases.where(title_block | ~F.col("__blank"))
    case_value = lambda c: F.when(title_block & ok_method, c)
    return kept.select(
        "file_id",
        F.when(title_block, F.col("seq")).otherwise(F.lit(0)).alias("seq"),
        F.when(title_block, F.col("title")).alias("title"),
        case_value(F.col("__method")).alias("method"),
        case_value(F.col("__path")).alias("path"),
        case_value(F.col("__body")).alias("body_raw"),
        # what is sent: a multi-search body ends with a line feed
        case_value(F.when(ndjson, F.concat(F.col("__body"), F.lit("\n"))).otherwise(F.col("__body"))).alias("body_sent"),
        case_value(ndjson).alias("body_is_ndjson"),
        case_value(valid_json).alias("body_valid"),
        F.when(title_block, error).otherwise(F.lit(ERR_PREAMBLE)).alias("error"),
    )


def request_targets(cases: DataFrame) -> DataFrame:
    """One row per (case, addressed index name), position kept."""
    return cases.where(F.col("error").isNull()).select(
        "file_id", "seq", F.posexplode(target_names(F.col("path"))).alias("target_pos", "target")
    )


def resolve_aliases(targets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias -> concrete indices; unknown names stay themselves.

    Order-preserving dedupe per case: an index keeps the position of its
    first appearance.  ``aliases`` has ``alias, index``, a row per index.  A
    handful of names covers most requests, so the alias table is broadcast up
    to a size, or joined with salted keys beyond it; the rest happens inside
    the case's partition.  The joined rows are written, which tells their
    number: cases are dealt out so that a task sorts about ``TASK_ROWS`` of
    them however well the shuffled rows compress.
    """
    a = aliases.where(F.col("alias").isNotNull()).select(F.col("alias").alias("target"), F.col("index").alias("__index")).where("__index is not null").distinct()
    j = lookup_join(targets, a, "target").select("file_id", "seq", "target_pos", F.coalesce("__index", "target").alias("index_name"))
    j = write_shared(j, "resolved")
    j = j.repartition(j.count() // TASK_ROWS + 1, "file_id", "seq")
    # Both windows share the (file, case) partitioning: one exchange.  The
    # first keeps each index's earliest appearance, the second numbers them.
    by_name = Window.partitionBy("file_id", "seq").orderBy("index_name", "target_pos")
    first = j.withColumn("__prev", F.lag("index_name").over(by_name)).where(
        F.col("__prev").isNull() | (F.col("__prev") != F.col("index_name"))
    )
    by_pos = Window.partitionBy("file_id", "seq").orderBy("target_pos", "index_name")
    return first.select("file_id", "seq", "index_name", F.row_number().over(by_pos).alias("resolved_pos"))


# The overview columns of an index, in order.
OVERVIEW_TEXTS = ("health", "status", "pri", "rep", "store_size", "pri_store_size")
OVERVIEW_COUNTS = ("docs_count", "docs_deleted")


def index_overview(resolved: DataFrame, overview: DataFrame) -> DataFrame:
    """Resolved index ⟕ ``_cat/indices`` facts, ``-`` for unknown ones and for
    facts that the overview does not have (J6, R5, U4)."""
    known = [F.col(c) if c in overview.columns else F.lit(None) for c in OVERVIEW_TEXTS + OVERVIEW_COUNTS]
    facts = overview.select(F.col("index").alias("index_name"), *[k.cast("string").alias(f"__{c}") for k, c in zip(known, OVERVIEW_TEXTS + OVERVIEW_COUNTS, strict=True)])
    j = lookup_join(resolved, facts, "index_name")
    return j.select(
        *resolved.columns,
        *[F.coalesce(F.col(f"__{c}"), F.lit("-")).alias(c) for c in OVERVIEW_TEXTS],
        *[format_count(F.col(f"__{c}")).alias(c) for c in OVERVIEW_COUNTS],
    )


def index_report(resolved: DataFrame, overview: DataFrame, mappings: DataFrame, settings: DataFrame) -> DataFrame:
    """Everything a request report says about an index (J6): the overview, the
    mapping and the settings (text; null where none was fetched)."""
    out = index_overview(resolved, overview)
    for facts, column in ((mappings, "mapping"), (settings, "settings")):
        out = lookup_join(out, facts.select(F.col("index").alias("index_name"), F.col(column).cast("string").alias(column)), "index_name")
    return out
