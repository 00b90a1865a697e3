"""The registered queries: each operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siftline.functions.text import split_lines
from siftline.model import CsvConfig, InputConfig
from siftline.operators.classify import classify_text, fit_text_classifier, only_high_interest
from siftline.operators.diagnose import diagnose
from siftline.operators.enrich import ENRICHERS, LOOKUPS, active_enrichers, enrich, enrich_saved, listing_table
from siftline.operators.library import LIBRARY
from siftline.operators.patterns import select_patterns
from siftline.operators.prune import min_entropy, unique_findings, unseen_findings
from siftline.operators.rewrite import rewrite_fields
from siftline.operators.scan import as_findings, grep_lines, hits_per_pattern, scan
from siftline.operators.summary import scan_progress, scan_summary, total_hits
from siftline.plans.inputs import (
    DIGITS, ENTITIES, FLAGGED, frequent_patterns, HEAD_SEED, KEYED, SEEDS, TITLES, WORDS, document_findings, document_lines, documents, event_lines, library, new_folder, pages,
    table, turns, written_lines,
)
from siftline.session import stored
from siftline.sinks.outputs import (
    findings_table, list_runs, load_run, markdown_report, render_template, report_entries, save_run, to_content_lines, to_text_lines,
    with_finding_ids, write_findings_json, write_text,
)
from siftline.sources.appended import scan_appended
from siftline.sources.bigjson import large_json_leaves
from siftline.sources.csv import read_csv_records
from siftline.sources.documents import expand_json_document
from siftline.sources.files import (
    done_files, list_files, read_any_records, read_records, read_target_list, remaining_files,
)
from siftline.sources.findings import read_grep_output, read_findings
from siftline.sources.jsonl import jsonl_records
from siftline.sources.lines import literal_path, read_lines, row_in_task
from siftline.sources.prepare import transform_fields, unescape_content
from siftline.sources.presets import PRESETS
from siftline.sources.tables import read_table_records
from siftline.streaming.seen import SeenKeys, unique_over_runs
from siftline.streaming.streams import run_available, run_classified, scan_numbered, scan_stream, stream_lines, unique_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(name: str = "entropy", digits: int = 9) -> Column:
    return F.round(name, digits).alias(name)


def outputs() -> Column:
    """Tool outputs as one text."""
    return F.array_join(F.transform(
        "tool_data", lambda output: F.concat(output["tool_id"], F.lit("="), output["value"])
    ), "|").alias("outputs")


# Matching.

@query
def scan_documents(spark, folder):
    found = scan(documents(spark, folder), library("ip,http-auth,strings,urls"))
    return found.select("doc_id", "pattern", "ordinal", "content", rounded())


@query
def scan_groups(spark, folder):
    found = scan(documents(spark, folder), library("ip,php-sinks"))
    return found.select("doc_id", "pattern", "ordinal", F.array_join("matches", "|").alias("groups"))


@query
def scan_all_lines(spark, folder):
    return scan(documents(spark, folder), library("all_lines")).select("doc_id", "ordinal", "content")


@query
def scan_library(spark, folder):
    """All shipped patterns in one pass."""
    return scan(pages(spark, folder, "url", "html"), LIBRARY).select("page_id", "target", "pattern", "ordinal", "content")


@query
def scan_deep_pattern(spark, folder):
    """A pattern with an unbounded repeat of a group."""
    return scan(documents(spark, folder), [TITLES]).select(
        "doc_id", "ordinal", "content", F.col("matches")[1].alias("last_word")
    )


@query
def scan_many(spark, folder):
    """Five hundred patterns, each a word that documents start with and what follows it up to the end of the line."""
    return scan(documents(spark, folder), frequent_patterns(spark, folder)).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("found"), F.countDistinct("content").alias("contents"),
    )


@query
def scan_targets(spark, folder):
    """Several columns of a table as targets."""
    found = scan(turns(spark, folder, "role", "text"), [*library("all_lines"), WORDS])
    return found.select("conv_id", "turn", "target", "pattern", "ordinal", "content")


@query
def select_by_tag(spark, folder):
    chosen = select_patterns(LIBRARY, tags=["cloud", "recon", "storage"])
    return scan_summary(scan(pages(spark, folder, "url", "html"), chosen))


@query
def grep_document_lines(spark, folder):
    found = grep_lines(document_lines(spark, folder), library("ip,http-auth,strings"))
    return found.select("doc_id", "line", "pattern", "content")


@query
def pattern_hits(spark, folder):
    return hits_per_pattern(pages(spark, folder, "html"), LIBRARY)


@query
def diagnose_events(spark, folder):
    config = InputConfig(
        format="jsonl", targets=("event_type", "meta.props", "meta.none"), decode=True, filters={"event_type": "click"}
    )
    verdicts = diagnose(event_lines(spark, folder), [DIGITS], config)
    return verdicts.select(F.col("line").alias("event_id"), "stage", "subject", "outcome", "detail")


@query
def diagnose_csv(spark, folder):
    lines = table(spark, folder, "customer").select(
        F.concat_ws(";", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('"')), "c_mktsegment").alias("value"),
        F.lit("customer").alias("file"), F.col("c_custkey").alias("line"),
    )
    config = InputConfig(format="csv", csv=CsvConfig(separator=";", target_indices=(1, 2, 3)))
    verdicts = diagnose(lines, [DIGITS], config)
    return verdicts.select(F.col("line").alias("c_custkey"), "stage", "subject", "outcome", "detail")


@query
def diagnose_csv_ragged(spark, folder):
    """Customers under a header, every third one with a cell too many."""
    rows = table(spark, folder, "customer").select(
        F.concat_ws(",", "c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, F.lit("more"))).alias("value"),
        F.lit("customer").alias("file"), F.col("c_custkey").alias("line"),
    )
    head = spark.createDataFrame([("id,name", "customer", -1)], rows.schema)
    config = InputConfig(format="csv", csv=CsvConfig(has_header=True, target_indices=(1,)))
    verdicts = diagnose(rows.unionByName(head), [DIGITS], config)
    return verdicts.select(F.col("line").alias("c_custkey"), "stage", "subject", "outcome", "detail")


@query
def scan_flags(spark, folder):
    """Patterns with flag groups, empty alternatives, edges and folded complements."""
    return scan(documents(spark, folder), FLAGGED).select("doc_id", "pattern", "ordinal", "content")


@query
def scan_seeded(spark, folder):
    """Documents between texts in which every shipped pattern finds something."""
    records = documents(spark, folder).withColumn("content", F.concat(F.lit(HEAD_SEED), "content", F.lit(SEEDS)))
    return scan(records, LIBRARY).select("doc_id", "pattern", "ordinal", "content")


# Scoring and pruning.

@query
def entropy(spark, folder):
    found = scan(pages(spark, folder, "html"), library("strings"))
    return found.select("page_id", "ordinal", "content", rounded())


@query
def high_entropy(spark, folder):
    found = min_entropy(scan(pages(spark, folder, "html"), library("strings")))
    return found.select("page_id", "ordinal", "content", rounded())


@query
def unique_matches(spark, folder):
    found = document_findings(spark, folder).select("pattern", "content", "doc_id", "ordinal")
    return unique_findings(found, order=["doc_id", "ordinal"])


@query
def unseen_matches(spark, folder):
    """Lines and addresses in documents that no benchmark passage held."""
    names = library("ip,http-auth,all_lines")
    history = scan(read_table_records(table(spark, folder, "benchmark"), "item_id", ["text"]), names)
    found = scan(documents(spark, folder), names).select("pattern", "content", "doc_id", "ordinal")
    return unseen_findings(found, history, order=["doc_id", "ordinal"])


def _quality(spark, folder):
    marks = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return table(spark, folder, "documents").join(marks, "doc_id").select("text", "label")


@query
def classifier_fit(spark, folder):
    model = fit_text_classifier(_quality(spark, folder))
    return model.gains.select("token", *[
        F.round(F.col("gains")[index], 9).alias(f"gain_{label}") for index, label in enumerate(model.labels)
    ])


@query
def classifier_apply(spark, folder):
    model = fit_text_classifier(_quality(spark, folder))
    scored = classify_text(table(spark, folder, "documents"), model, ["doc_id"])
    return scored.select("doc_id", "label", rounded("score_0", 3), rounded("score_1", 3))


@query
def smart_filter(spark, folder):
    found = only_high_interest(scan(documents(spark, folder), [WORDS]))
    return found.select("doc_id", "ordinal", "content")


@query
def classifier_ngrams(spark, folder):
    talk = table(spark, folder, "conversations").select("text", F.col("role").alias("label"))
    model = fit_text_classifier(talk, ngram=2)
    return model.gains.select("token", *[
        F.round(F.col("gains")[index], 9).alias(f"gain_{label}") for index, label in enumerate(model.labels)
    ])


@query
def smart_filter_fitted(spark, folder):
    """Lines of conversations that a model fitted to documents puts in the class of good quality."""
    found = scan(turns(spark, folder, "text"), library("all_lines"))
    kept = only_high_interest(found, fit_text_classifier(_quality(spark, folder)), "1")
    return kept.select("conv_id", "turn", "ordinal", "content")


@query
def stream_classified(spark, folder):
    """Lines of documents that a model fitted to documents puts in the class of good quality, as they arrive."""
    model = fit_text_classifier(_quality(spark, folder))
    source, target = written_lines(spark, folder), new_folder(spark)
    lines = stream_lines(spark, source, max_files=3).withColumn("value", F.expr("substring(value, instr(value, '\t') + 1)"))
    rows = scan_stream(lines, library("all_lines")).select("content")
    run_classified(rows, target, f"{target}-checkpoint", model, "1").awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(target)


# Records.

@query
def jsonl_fields(spark, folder):
    config = InputConfig(
        format="jsonl", targets=("meta.user_id", "meta.props", "marks", "meta.none"), id="event_id",
        filters={"event_type": "click"},
    )
    return jsonl_records(event_lines(spark, folder), config).select("record_id", "target", "content", "file")


@query
def jsonl_long(spark, folder):
    """Events with a field of up to 21 million characters: lengths of the fields, and a filter on one."""
    pad = F.repeat(F.lit("x"), F.when(F.col("event_id") == 7, 21_000_000).otherwise(F.col("event_id") % 50).cast("int"))
    lines = table(spark, folder, "events").select(
        F.to_json(F.struct("event_id", pad.alias("pad"), F.lit(1.0).alias("one"))).alias("value"),
        F.lit("events").alias("file"), F.col("event_id").alias("line"),
    )
    config = InputConfig(format="jsonl", targets=("pad", "one"), filters={"one": "1"})
    return jsonl_records(lines, config).select(F.col("line").alias("event_id"), "target", F.char_length("content").alias("chars"))


@query
def json_documents(spark, folder):
    """Regions and nations as pretty documents of many lines, customers as one document a line."""
    target = new_folder(spark)
    pretty = {"pretty": "true", "ignoreNullFields": "false"}
    table(spark, folder, "nation").select(F.to_json(
        F.struct("n_nationkey", F.struct("n_name", F.array("n_regionkey").alias("in")).alias("of")), pretty,
    ).alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(f"{target}/pretty")
    table(spark, folder, "customer").select(F.to_json(F.struct("c_name")).alias("value")).write.text(f"{target}/lines")
    records = read_records(spark, target, PRESETS["beautify_json"])
    return records.groupBy("target", "content").agg(F.count(F.lit(1)).alias("found"))


@query
def json_large(spark, folder):
    """Events as a few JSON arrays, each one document of a file, cut into parts of 64 kB; leaves by event."""
    target = new_folder(spark)
    lines = event_lines(spark, folder).select("event_id", "value").repartitionByRange("event_id").sortWithinPartitions("event_id")
    placed = stored(lines.withColumns({"part": F.spark_partition_id(), "place": row_in_task()}))
    last = placed.groupBy("part").agg(F.max("place").alias("last"))
    text = F.concat(F.when(F.col("place") == 0, "[").otherwise(","), "value", F.when(F.col("place") == F.col("last"), "]").otherwise(""))
    ordered = placed.join(last, "part").select("part", "place", text.alias("value")).repartition("part").sortWithinPartitions("part", "place")
    ordered.select("part", "value").write.partitionBy("part").text(target)
    leaves = large_json_leaves(spark, list_files(spark, target, glob="*.txt"), block=1 << 18, most=1 << 16)
    element = leaves.select("file", F.regexp_extract("path", r"^\$\[([0-9]+)\]", 1).alias("element"), "value", F.regexp_replace("path", r"^\$\[[0-9]+\]", "\\$").alias("path"))
    events = element.filter("path = '$.event_id'").select("file", "element", F.col("value").cast("bigint").alias("event_id"))
    return element.join(events, ["file", "element"]).select("event_id", "path", "value")


@query
def jsonl_malformed(spark, folder):
    """Lines that are no objects, given whole because the whole line is a target."""
    lines = document_lines(spark, folder).select(F.col("content").alias("value"), "file", "line", "doc_id")
    records = jsonl_records(lines.unionByName(event_lines(spark, folder).select(
        "value", "file", "line", F.lit(-1).cast("bigint").alias("doc_id")
    )), InputConfig(format="jsonl", targets=("$", "meta.user_id"), filters={"event_type": "view"}))
    return records.select("source_file", "line", "target", "content")


@query
def json_table_fields(spark, folder):
    lines = table(spark, folder, "events").select(
        F.col("props").alias("value"), F.lit("events").alias("file"), F.col("event_id").alias("line")
    )
    config = InputConfig(format="jsonl", targets=("k",))
    return jsonl_records(lines, config).select(F.col("line").alias("event_id"), "content")


@query
def csv_cells(spark, folder):
    """Documents written as CSV with line breaks inside the cells, and read back."""
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    target = new_folder(spark)
    table(spark, folder, "documents").select(
        F.concat_ws(",", "doc_id", quoted, "source").alias("value")
    ).write.text(target)
    return read_csv_records(spark, target, CsvConfig(target_indices=(1, 2))).select("record_id", "target", "content")


@query
def csv_plain(spark, folder):
    target = new_folder(spark)
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    customers.write.csv(target, header=True, sep=";")
    config = CsvConfig(separator=";", has_header=True)
    return read_csv_records(spark, target, config).select("record_id", "target", "content")


@query
def csv_ragged(spark, folder):
    """Documents under a header, some rows a cell too long, with the numbers of the rows that are left."""
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("place"),
        F.concat_ws(",", "doc_id", quoted, F.when(F.col("doc_id") % 4 == 1, F.lit("more"))).alias("value"),
    )
    target = new_folder(spark)
    # Files of neighbouring documents, each with a header of its own; rows are numbered in their file.
    ordered = rows.repartitionByRange("place").sortWithinPartitions("place")
    ordered.select(F.when(row_in_task() == 0, F.concat(F.lit("id,text\n"), "value")).otherwise(F.col("value")).alias("value")).write.text(target)
    records = read_csv_records(spark, target, CsvConfig(has_header=True, target_indices=(1,)))
    # The same numbers counted on over the files.
    files = records.groupBy("source_file").agg(F.max("line").alias("rows"), F.min(F.col("record_id").cast("bigint")).alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = files.select("source_file", before.alias("before"))
    return records.join(offsets, "source_file").select("record_id", (F.col("line") + F.col("before")).alias("line"), "content")


@query
def ignored_files(spark, folder):
    """Lines of all documents as files of three endings; two endings are left out, and the files of one language by name."""
    target = new_folder(spark)
    lines = table(spark, folder, "documents").select("lang", F.explode(split_lines(F.col("text"))).alias("value"))
    # A task gives its files of all folders the same name, so the language to be left out is written on its own.
    german = F.coalesce(F.col("lang") == "de", F.lit(False))
    lines.filter(german).select("value").write.text(f"{target}/german")
    lines.filter(~german).select("value").write.text(f"{target}/others")
    lines.write.json(f"{target}/json")
    lines.write.csv(f"{target}/csv")
    names = [row["path"].rsplit("/", 1)[1] for row in list_files(spark, f"{target}/german", glob="*.txt").collect()]
    records = read_records(spark, target, InputConfig(), line_numbers=False, ignore_extensions=["json", ".csv"], ignore_names=names)
    found = scan(records, library("ip,http-auth"))
    return found.groupBy("pattern", "content").agg(F.count(F.lit(1)).alias("found"))


@query
def text_lines(spark, folder):
    """Documents written as text and read with line numbers, made relative to each document."""
    lines = read_lines(spark, written_lines(spark, folder)).select(
        F.split_part("value", F.lit("\t"), F.lit(1)).cast("bigint").alias("doc_id"),
        F.expr("substring(value, instr(value, '\t') + 1)").alias("content"), "line",
    )
    first = lines.groupBy("doc_id").agg(F.min("line").alias("first"))
    return lines.join(first, "doc_id").select("doc_id", (F.col("line") - F.col("first") + 1).alias("line"), "content")


@query
def mixed_formats(spark, folder):
    """One folder with text, JSON lines and CSV files."""
    target = new_folder(spark)
    table(spark, folder, "pages").select("page_id", "url").write.json(f"{target}/pages")
    table(spark, folder, "customer").select("c_custkey", "c_name").write.csv(f"{target}/customers")
    table(spark, folder, "documents").select(F.explode(split_lines(F.col("text"))).alias("value")).write.text(
        f"{target}/documents"
    )
    config = InputConfig(csv=CsvConfig(target_indices=(1,)))
    found = scan(read_any_records(spark, target, config), library("urls,ip,http-auth,all_lines"))
    return found.groupBy("pattern", "target", "content").agg(F.count(F.lit(1)).alias("found"))


@query
def preset_records(spark, folder):
    """Pages as the JSON lines of a crawler, read by a preset."""
    lines = table(spark, folder, "pages").select(
        F.to_json(F.struct("url", F.col("html").alias("body"))).alias("value"), F.lit("crawl").alias("file"),
        F.col("page_id").alias("line"),
    )
    found = scan(jsonl_records(lines, PRESETS["js_finder"]), library("strings,http-auth"))
    return found.select("file", "line", "pattern", "ordinal", "content")


@query
def expand_json(spark, folder):
    lines = event_lines(spark, folder).select("event_id", F.col("value").alias("document"))
    return expand_json_document(lines).select("event_id", "path", "value")


@query
def grep_output(spark, folder):
    lines = document_lines(spark, folder).select(
        F.concat(F.lit("doc-"), "record_id", F.lit(".txt:"), "line", F.lit(":"), "content").alias("value")
    )
    return read_grep_output(lines).select("file", "ext", "line", "content")


@query
def resume_scan(spark, folder):
    """Scan one language's files, note them as done, then scan what remains."""
    target = new_folder(spark)
    lines = table(spark, folder, "documents").select("lang", F.explode(split_lines(F.col("text"))).alias("value"))
    lines.write.partitionBy("lang").text(target)
    patterns = library("ip,http-auth")

    def run(number, files):
        paths = [literal_path(row["path"]) for row in files.select("path").collect()]
        found = scan(read_records(spark, paths, InputConfig(), line_numbers=False), patterns)
        return found.select(F.lit(number).alias("run"), "pattern", "content")

    first = list_files(spark, f"{target}/lang=en", glob="*.txt")
    done_files(first).write.parquet(f"{target}-done")
    rest = remaining_files(list_files(spark, target, glob="*.txt"), spark.read.parquet(f"{target}-done"))
    return run(1, first).unionByName(run(2, rest))


def _by_document(found):
    """Lines ``doc_id TAB text`` with their numbers counted from the first of each document."""
    lines = found.select(
        F.split_part("content", F.lit("\t"), F.lit(1)).cast("bigint").alias("doc_id"),
        F.expr("substring(content, instr(content, '\t') + 1)").alias("content"), "line",
    )
    first = lines.groupBy("doc_id").agg(F.min("line").alias("first"))
    return lines.join(first, "doc_id").select("doc_id", (F.col("line") - F.col("first") + 1).alias("line"), "content")


@query
def resume_lines(spark, folder):
    """Files of document lines read some part at a time, each run going on within the files, with the lines' numbers."""
    source, target, state = written_lines(spark, folder), new_folder(spark), new_folder(spark)
    longest = list_files(spark, source, glob="*.txt").agg(F.max("length")).first()[0] or 0

    def sink(found, number):
        found.select("content", "line").write.mode("overwrite").parquet(f"{target}/run={number}")

    while scan_appended(spark, source, [KEYED], state, sink, glob="*.txt", block=1 << 20, most=longest // 3 + 1):
        pass
    return _by_document(spark.read.schema("content string, line bigint").parquet(target))


@query
def target_list(spark, folder):
    """Files named by a list, scanned in one run."""
    source = written_lines(spark, folder)
    listed = new_folder(spark)
    list_files(spark, source, glob="*.txt").select(F.col("path").alias("value")).write.text(listed)
    records = read_records(spark, read_target_list(spark, listed), InputConfig(), line_numbers=False)
    found = scan(records, library("ip,http-auth"))
    return found.groupBy("pattern", "content").agg(F.count(F.lit(1)).alias("found"))


@query
def unescape(spark, folder):
    escaped = F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"')),
                        F.lit("é"), F.lit("\\u00e9"))
    talk = table(spark, folder, "conversations").select("conv_id", "turn", escaped.alias("content"))
    lines = document_lines(spark, folder).select(
        F.col("doc_id").alias("conv_id"), F.col("line").alias("turn"),
        F.replace("content", F.lit("é"), F.lit("\\u00e9")).alias("content"),
    )
    return unescape_content(talk).unionByName(unescape_content(lines))


@query
def transform_targets(spark, folder):
    records = turns(spark, folder, "role", "text")
    changed = transform_fields(records, {"role": F.upper, "$": lambda text: F.replace(text, F.lit("e"), F.lit("3"))})
    return changed.select("conv_id", "turn", "target", "content")


@query
def rewrite(spark, folder):
    lines = table(spark, folder, "events").select("event_id", F.col("props").alias("value"))
    return rewrite_fields(lines, {"k": lambda text: F.concat(F.lit(" v"), text)}).select("event_id", "value")


# Enrichment.

@query
def enrich_chain(spark, folder):
    found = scan(pages(spark, folder, "url"), library("urls"))
    chain = active_enrichers(["extract_domain", "extract_path", "rev_str", "t1", "t2", "echo_val"], ENRICHERS.values())
    return enrich(found, chain).select("page_id", "content", outputs())


@query
def enrich_some(spark, folder):
    """A step that applies to one pattern of three."""
    step = type(ENRICHERS["rev_str"])("rev_str", "reversed", ENRICHERS["rev_str"].value, apply_to=("ip",))
    return enrich(document_findings(spark, folder), [step]).select("doc_id", "pattern", "ordinal", "content", outputs())


@query
def enrich_hosts(spark, folder):
    """All other lookups in one chain, each keyed by the host, with joins by shuffle."""
    hosts = table(spark, folder, "pages").groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("key")).agg(
        F.count(F.lit(1)).alias("value"))
    found = scan(pages(spark, folder, "url"), library("urls"))
    names = ("host_dns", "reverse_dns", "shodan_lookup", "nmap_fast", "curl_head", "check_s3", "ping_host")
    chain = [ENRICHERS["extract_domain"], *[
        replace(LOOKUPS[name].using(hosts.filter(F.col("value") > number)), source="extract_domain") for number, name in enumerate(names)
    ]]
    return enrich(found, chain, broadcast_rows=0).select("page_id", "content", outputs())


@query
def enrich_base64(spark, folder):
    coded = turns(spark, folder, "text").withColumn("content", F.translate(F.base64(F.encode("content", "UTF-8")), "\r\n", ""))
    found = scan(coded, [*library("all_lines")])
    return enrich(found, [ENRICHERS["b64_decode"]]).select("conv_id", "turn", outputs())


@query
def enrich_decoders(spark, folder):
    talk = turns(spark, folder, "text").withColumn("content", F.concat_ws(
        " ", F.md5("content"), F.url_encode("content"), F.lit("8.8.8.8 and 10.1.2.3")
    ))
    found = scan(talk, library("all_lines"))
    chain = [
        ENRICHERS["extract_ip"], ENRICHERS["url_decode"],
        type(ENRICHERS["hash_id"])("hash_id", "hash_type", ENRICHERS["hash_id"].value, extract=r"^[0-9a-f]+"),
    ]
    return enrich(found, chain).select("conv_id", "turn", outputs())


@query
def enrich_json(spark, folder):
    found = scan(read_table_records(table(spark, folder, "events"), "event_id", ["props"], "events", ["event_id"]),
                 library("all_lines"))
    return enrich(found, [ENRICHERS["jq_pretty"], ENRICHERS["extract_tech"]]).select("event_id", outputs())


@query
def enrich_tokens(spark, folder):
    """Events as web tokens and as JSON strings."""
    def coded(text):
        return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))

    events = table(spark, folder, "events").withColumns({
        "token": F.concat_ws(".", coded(F.concat(F.lit('{"alg":"'), "event_type", F.lit('"}'))), coded(F.col("props")), F.lit("x")),
        "string": F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"')),
    })
    found = scan(read_table_records(events, "event_id", ["token", "string"], "events", ["event_id"]), library("all_lines"))
    return enrich(found, [ENRICHERS["jwt_decode"], ENRICHERS["unquote_json"]]).select("event_id", "target", outputs())


@query
def enrich_html(spark, folder):
    found = scan(pages(spark, folder, "html"), [ENTITIES])
    return enrich(found, [ENRICHERS["html_unescape"]]).select("page_id", "ordinal", "content", outputs())


@query
def enrich_lookup(spark, folder):
    """Registrar of a URL's host, from a table of hosts."""
    host = F.split_part("url", F.lit("/"), F.lit(3))
    hosts = table(spark, folder, "pages").groupBy(host.alias("key")).agg(
        F.concat(F.lit("pages:"), F.count(F.lit(1))).alias("value")
    )
    found = scan(pages(spark, folder, "url"), library("urls"))
    chain = [ENRICHERS["extract_domain"], type(LOOKUPS["whois"])("whois", "registrar", hosts, source="extract_domain")]
    return enrich(found, chain).select("page_id", "content", outputs())


def _owners(found):
    """Networks made from the findings: every first octet, and every first two octets that were found more than once."""
    step = [F.split_part("content", F.lit("."), F.lit(part)) for part in (1, 2)]
    wide = found.select(F.concat(step[0], F.lit(".0.0.0/8")).alias("key"), F.concat(F.lit("org-"), step[0]).alias("value"))
    pair = F.concat(step[0], F.lit("."), step[1])
    near = found.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("found")).filter("found > 1").select(
        F.concat("pair", F.lit(".0.0/16")).alias("key"), F.concat(F.lit("org-"), "pair").alias("value")
    )
    return stored(wide.unionByName(near).dropDuplicates())


@query
def enrich_networks(spark, folder):
    """Owner of an address by its longest network."""
    found = scan(documents(spark, folder), library("ip"))
    return enrich(found, [LOOKUPS["ip_info"].using(_owners(found))]).select("doc_id", "ordinal", "content", outputs())


@query
def enrich_networks_stream(spark, folder):
    """The same for addresses in lines that arrive as a stream."""
    networks = _owners(scan(documents(spark, folder), library("ip")))
    source, target = written_lines(spark, folder), new_folder(spark)
    found = enrich(scan_stream(stream_lines(spark, source, max_files=3), library("ip")), [LOOKUPS["ip_info"].using(networks)])
    rows = found.select("content", outputs())
    run_available(rows, target, f"{target}-checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)


@query
def enrich_listing(spark, folder):
    crawl = listing_table(table(spark, folder, "pages"))
    found = scan(pages(spark, folder, "url"), library("all_lines"))
    return enrich(found, [LOOKUPS["dir_listing"].using(crawl)]).select("page_id", outputs())


@query
def enrich_saved_findings(spark, folder):
    """Findings written as JSON, read back and enriched without another scan."""
    target = new_folder(spark)
    write_findings_json(document_findings(spark, folder), target)
    found = enrich_saved(read_findings(spark, target), [ENRICHERS["rev_str"]])
    return found.select("pattern", "file", "content", rounded(), outputs())


# Sinks.

@query
def text_output(spark, folder):
    found = enrich(document_findings(spark, folder), [ENRICHERS["rev_str"]])
    return to_text_lines(found)


@query
def content_output(spark, folder):
    return to_content_lines(document_findings(spark, folder))


@query
def table_output(spark, folder):
    return findings_table(document_findings(spark, folder))


@query
def template_output(spark, folder):
    return render_template(document_findings(spark, folder, "ip"), "{{pattern}}|{{match[1]}}|{{file}}|{{entropy}}|{{match[9]}}")


@query
def report_output(spark, folder):
    return report_entries(document_findings(spark, folder))


@query
def report_texts(spark, folder):
    """The whole report, numbered in its order."""
    report = markdown_report(scan(documents(spark, folder), library("ip,http-auth")), "# Found")
    target = new_folder(spark)
    write_text(report, target)
    # An entry has two lines; the title stands alone in front.
    lines = read_lines(spark, target).select("file", "line", "value")
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    start = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(start, "file").select((F.col("before") + F.col("line")).alias("number"), "value")


@query
def saved_runs(spark, folder):
    target = new_folder(spark)
    save_run(document_findings(spark, folder, "ip"), target, "addresses")
    save_run(document_findings(spark, folder, "strings"), target, "strings")
    save_run(document_findings(spark, folder, "http-auth"), target, "strings")
    runs = list_runs(spark, target)
    united = load_run(spark, target, "addresses").withColumn("run_id", F.lit("addresses")).unionByName(
        load_run(spark, target, "strings").withColumn("run_id", F.lit("strings"))
    )
    return united.join(runs, "run_id").select("run_id", "pattern", "file", "content")


@query
def finding_ids(spark, folder):
    found = document_findings(spark, folder)
    return with_finding_ids(found, ["doc_id", "pattern", "ordinal"]).select("id", "doc_id", "pattern", "ordinal", "content")


# Summaries.

@query
def hit_total(spark, folder):
    return total_hits(as_findings(document_findings(spark, folder)))


@query
def progress(spark, folder):
    return scan_progress(turns(spark, folder, "role", "text").unionByName(
        pages(spark, folder, "html").withColumns({"conv_id": F.lit(0).cast("bigint"), "turn": F.lit(0).cast("bigint")})
        .drop("page_id")
    ))


@query
def summary(spark, folder):
    return scan_summary(document_findings(spark, folder))


# Streaming.

@query
def stream_numbered(spark, folder):
    """Lines found by a stream with their numbers, made relative to each document."""
    source, target = written_lines(spark, folder), new_folder(spark)

    def sink(found, number):
        found.select("content", "line").write.mode("overwrite").parquet(f"{target}/batch={number}")

    scan_numbered(spark, source, [KEYED], f"{target}-checkpoint", sink, max_files=3).awaitTermination()
    return _by_document(spark.read.schema("content string, line bigint").parquet(target))


@query
def stream_scan(spark, folder):
    """Files of document lines scanned as a stream, to the end."""
    source, target = written_lines(spark, folder), new_folder(spark)
    found = scan_stream(stream_lines(spark, source, max_files=3), library("ip,http-auth"))
    rows = found.select("pattern", "ordinal", "content", rounded())
    run_available(rows, target, f"{target}-checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)


@query
def stream_csv(spark, folder):
    """Customers as CSV files, scanned as they arrive."""
    source, target = new_folder(spark), new_folder(spark)
    table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(source)
    config = InputConfig(format="csv", csv=CsvConfig(target_indices=(1, 2)))

    def sink(found, number):
        found.select("record_id", "target", "pattern", "content").write.mode("overwrite").parquet(f"{target}/batch={number}")

    scan_numbered(spark, source, [DIGITS, *library("all_lines")], new_folder(spark), sink, config).awaitTermination()
    return spark.read.parquet(target).drop("batch")


@query
def stream_unique(spark, folder):
    source, target = written_lines(spark, folder), new_folder(spark)
    found = unique_stream(scan_stream(stream_lines(spark, source), library("ip,http-auth")))
    rows = found.select("pattern", "content")
    run_available(rows, target, f"{target}-checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)


@query
def stream_unique_runs(spark, folder):
    """Matches that are new over three runs of a stream that share a stored set; each run brings its own files."""
    source, target = new_folder(spark), new_folder(spark)
    lines = table(spark, folder, "documents").select(
        F.pmod("doc_id", F.lit(3)).alias("run"), "doc_id", F.explode(split_lines(F.col("text"))).alias("value"),
    ).select("run", F.concat_ws("\t", "doc_id", "value").alias("value"))
    lines.write.partitionBy("run").text(source)
    seen = SeenKeys(spark, new_folder(spark))
    for run in range(3):
        found = scan_stream(stream_lines(spark, f"{source}/run={run}"), library("ip,http-auth")).select("pattern", "content")

        def sink(rows, number, run=run):
            rows.write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

        unique_over_runs(found, seen, f"run {run}", new_folder(spark), sink).awaitTermination()
    return spark.read.schema("pattern string, content string").parquet(target).select("pattern", "content")
