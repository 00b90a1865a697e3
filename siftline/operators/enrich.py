"""Adding facts to findings: a chain of enrichers, each seeing what earlier ones added."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import decode
from siftline.functions.regex import PatternError, translate_regex
from siftline.functions.search import first_match
from siftline.functions.skew import fits_broadcast
from siftline.functions.template import main_match, render_placeholders, tool_value
from siftline.functions.text import trim_space
from siftline.model import TOOL_OUTPUT
from siftline.operators.networks import network_table, with_network
from siftline.session import configure

#: Lookup tables up to this many rows (and ``skew.BROADCAST_BYTES``) are sent to every task; larger
#: ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Enricher:
    """One step of the chain.

    Its input is the whole match, or the first match of ``extract`` in it; ``value`` turns the
    input into the output, or ``template`` builds the output from slots.  ``apply_to`` limits
    the step to some patterns.
    """

    id: str
    label: str
    value: Callable[[Column], Column] | None = None
    template: str | None = None
    extract: str = ""
    apply_to: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lookup:
    """A step that reads its output from a table of (key, value) with one row per key.

    The key is made from the input by ``key``, or from an earlier step's output if ``source``
    names one.  With ``cidr`` the table's keys are networks (``10.0.0.0/8``) and the longest one
    that holds the address wins.  ``missing`` is recorded where the table has no row.
    """

    id: str
    label: str
    table: DataFrame | None = None
    key: str = "key"
    value: str = "value"
    source: str = ""
    extract: str = ""
    cidr: bool = False
    missing: str = ""
    apply_to: tuple[str, ...] = ()
    key_of: Callable[[Column], Column] | None = field(default=None)

    def using(self, table: DataFrame, key: str = "key", value: str = "value") -> Lookup:
        """The same step reading from a table."""
        return replace(self, table=table, key=key, value=value)


def sub_extract(match: Column, expression: str) -> Column:
    """The first match of ``expression``, NULL where there is none; no expression means all."""
    if not expression:
        return match
    try:
        found = first_match(match, translate_regex(expression))
    except PatternError:
        return F.lit(None).cast("string")
    return F.nullif(found, F.lit(""))


def _record(findings: DataFrame, step: Enricher | Lookup, value: Column) -> DataFrame:
    """Append a step's output to ``tool_data`` unless it is empty or the step does not apply."""
    if step.apply_to:
        value = F.when(F.col("pattern").isin(list(step.apply_to)), value)
    output = F.struct(F.lit(step.id).alias("tool_id"), F.lit(step.label).alias("label"), F.col("_value").alias("value"))
    known = F.coalesce(F.col("_value"), F.lit("")) != ""
    return findings.withColumn("_value", trim_space(value)).withColumn(
        "tool_data", F.when(known, F.array_append("tool_data", output.cast(TOOL_OUTPUT))).otherwise(F.col("tool_data"))
    ).drop("_value")


def enrich(
    findings: DataFrame, chain: Iterable[Enricher | Lookup], broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Run the steps in order; a step listed twice runs twice.

    Steps with a value or a template are plain column expressions.
    """
    configure(findings.sparkSession)
    for step in chain:
        if isinstance(step, Lookup):
            findings = enrich_by_lookup(findings, step, broadcast_rows)
            continue
        extracted = sub_extract(main_match(), step.extract)
        if step.template is not None:
            value = F.when(extracted.isNotNull(), render_placeholders(step.template, extracted))
        else:
            value = step.value(extracted)
        findings = _record(findings, step, value)
    return findings


def enrich_by_lookup(findings: DataFrame, step: Lookup, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Attach a table's value to every finding whose key it holds; no finding is lost or doubled.

    Several rows of one key count as one, with the smallest value.  A table that is small by
    count and size is broadcast; otherwise the join is one that Spark splits where a key is frequent.
    Findings may be a stream; the table is read as it is when the step is set up.
    """
    if step.table is None:
        raise ValueError(f"lookup {step.id} has no table")
    extracted = tool_value(step.source) if step.source else sub_extract(main_match(), step.extract)
    key = step.key_of(extracted) if step.key_of else extracted
    keyed = findings.withColumn("_key", key)
    if step.cidr:
        joined = with_network(keyed, "_key", network_table(step.table, step.key, step.value), "_found", broadcast_rows)
    else:
        table = step.table.select(F.col(step.key).cast("string").alias("_key"), F.col(step.value).cast("string").alias("_found"))
        small = fits_broadcast(table, broadcast_rows)
        table = table.groupBy("_key").agg(F.min("_found").alias("_found"))
        joined = keyed.join(F.broadcast(table) if small else table, "_key", "left")
    found = F.coalesce("_found", F.lit(step.missing))
    result = _record(joined, step, F.when(F.col("_key").isNotNull(), found))
    return result.select(*findings.columns)


def enrich_saved(findings: DataFrame, chain: Iterable[Enricher | Lookup], **options) -> DataFrame:
    """Enrich findings of an earlier scan; nothing is searched again and nothing is pruned."""
    return enrich(findings, chain, **options)


# Ids and labels of the enrichers and the text they produce.
ENRICHERS: dict[str, Enricher] = {step.id: step for step in [
    Enricher("b64_decode", "decoded", decode.base64_text),
    Enricher("b64-decode", "Decoded Content", decode.base64_text, apply_to=("base64", "api-keys")),
    Enricher("url_decode", "decoded", decode.percent_decode),
    Enricher("html_unescape", "unescaped", decode.html_text),
    Enricher("jwt_decode", "jwt_data", decode.jwt_text),
    Enricher("jq_pretty", "formatted_json", decode.normal_json),
    Enricher("unquote_json", "unquoted", decode.json_value),
    Enricher("extract_domain", "domain", lambda text: decode.url_part(text, 3)),
    Enricher("extract_path", "path", lambda text: decode.url_part(text, 4, prefix="/")),
    Enricher("extract_ip", "ip", decode.dotted_quads),
    Enricher("extract_tech", "technologies", decode.technologies),
    Enricher("hash_id", "hash_type", decode.hash_kind),
    Enricher("rev_str", "reversed", F.reverse),
    Enricher("echo_val", "echoed", template="EXTRACTED: {{match}}"),
    Enricher("t1", "res1", template="STEP1:'{{match}}'"),
    Enricher("t2", "res2", template="STEP2:{{tool:t1}}"),
]}

# Ids and labels of the lookups; the user supplies the table.
LOOKUPS: dict[str, Lookup] = {step.id: step for step in [
    Lookup("ip_info", "organization", cidr=True),
    Lookup("host_dns", "ip_address"),
    Lookup("reverse_dns", "hostname"),
    Lookup("whois", "registrar"),
    Lookup("shodan_lookup", "shodan_data"),
    Lookup("nmap_fast", "open_ports"),
    Lookup("curl_head", "status"),
    Lookup("check_s3", "status_code"),
    Lookup("dir_listing", "listing_status", missing="Disabled"),
    Lookup("ping_host", "status", missing="Dead"),
]}


def listing_table(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(key, value) for the ``dir_listing`` lookup out of a table of crawled pages."""
    shown = F.contains(F.lower(html), F.lit("index of /"))
    return pages.select(F.col(url).alias("key"), F.when(shown, "Enabled").otherwise("Disabled").alias("value"))


def alive_table(hosts: DataFrame, host: str = "host", alive: str = "alive") -> DataFrame:
    """(key, value) for the ``ping_host`` lookup out of a table of liveness checks."""
    return hosts.select(F.col(host).alias("key"), F.when(F.col(alive), "Alive").otherwise("Dead").alias("value"))


def active_enrichers(ids: Iterable[str], catalog: Iterable[Enricher | Lookup]) -> list[Enricher | Lookup]:
    """Steps by id, in the order asked for; unknown ids are left out."""
    steps = list(catalog)
    return [step for name in ids for step in steps if step.id == name.strip()]
