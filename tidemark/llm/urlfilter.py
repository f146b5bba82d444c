"""URL rules whose block decisions reach aliases: pages joined by redirects and canonical links.

Hosts, paths and rules are expressions over a url. Aliases are the connected components of redirect and canonical-link
edges; a url without a rule of its own takes the decision of its component, where an allow rule goes before block rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import cut
from tidemark.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to / ? # or the end, A-Z lower-cased, and path up to ? or #; both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, *LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The url that stands for all spellings of its address: no fragment, A-Z of scheme and host lower-cased, no default port, / for an empty path."""
    u = F.split_part(url, F.lit("#"), F.lit(1))
    part = lambda k: F.regexp_extract(u, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?@]*@)?([^/?]*?)(:[0-9]*)?([/?].*)?$", k)
    scheme, host, port, rest = F.translate(part(1), *LOWER), F.translate(part(3), *LOWER), part(4), part(5)
    usual = (port == ":") | ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    whole = F.concat(scheme, F.lit("://"), part(2), host, F.when(usual, F.lit("")).otherwise(port), F.when(rest.startswith("/"), F.lit("")).otherwise(F.lit("/")), rest)
    return F.when(scheme == "", u).otherwise(whole)


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one. A rule fits its host and all subdomains."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, fit in reversed(list(zip(ordered, fits))):
        name, verdict = F.when(fit, F.lit(r.name)).otherwise(name), F.when(fit, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


def targets_of(url: str, tags: list[str]) -> list[str]:
    """Absolute urls that a page's link and meta tags name as its canonical address or redirect to."""
    out = []
    for tag in tags:
        a = {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(tag)}
        to = None
        if tag[:5].lower() == "<link" and "canonical" in a.get("rel", "").lower().split():
            to = a.get("href")
        elif a.get("http-equiv", "").lower() == "refresh" and (m := re.match(r"\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?['\"]?([^'\"]+)", a.get("content", ""), re.I)):
            to = m[1]
        if to and to.strip():
            try:
                out.append(urljoin(url, to.strip()))
            except ValueError:
                pass
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for url, tags in zip(batch.column("url").to_pylist(), batch.column("tags").to_pylist()):
            for to in targets_of(url, tags):
                a.append(url)
                b.append(to)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) for each canonical link or meta redirect of pages (url, html); tags in comments and scripts don't count."""
    low = F.lower("html")
    some = pages.where("url is not null").where(low.contains("canonical") | low.contains("refresh"))
    bare = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    tags = F.filter(F.regexp_extract_all(bare, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), 1), lambda t: F.lower(t).contains("canonical") | F.lower(t).contains("refresh"))
    found = some.select("url", tags.alias("tags")).where(F.size("tags") > 0)
    return found.mapInArrow(_edges, "a string, b string")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule, verdict.

    verdict is the rule's. Without a rule: block if an alias is blocked by a rule and none is allowed by one, else allow. Aliases
    are all urls, also of no page, reachable by canonical links, meta redirects and rows of `redirects` (a, b); urls that differ in the fragment, the case of
    scheme and host, a default port or an empty path are one. A null url has an empty host and path and no alias; null html names none. Null and repeated
    page_ids are rows like any other; extra columns are ignored; no rows give no rows. The rules are parameters, compiled into one expression.
    """
    host, path = host_path(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = matched(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": name, "own": verdict, "node": node(F.col("url"))})
    edges = alias_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("a", "b"))
    edges = cut(edges)
    groups = connected_components(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    h, p = host_path(F.col("url"))
    named = edges.select(F.explode(F.array("a", "b")).alias("url")).where("url is not null").distinct()
    _, said = matched(F.col("h"), F.col("p"), rules)
    named = named.select(node(F.col("url")).alias("node"), h.alias("h"), p.alias("p")).select("node", said.alias("said"))
    ruled = named.unionByName(own.select("node", F.col("own").alias("said"))).where("said is not null and node is not null")
    members = groups.select(F.col("id").alias("node"), "component")
    placed = ruled.groupBy("node").agg(F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked")).join(members, "node", "left")
    decided = placed.groupBy(F.coalesce("component", "node").alias("component")).agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    blocked = decided.where("blocked and not allowed").select("component")
    aliases = blocked.join(members, "component", "left").select(F.coalesce("node", "component").alias("node"), F.lit(True).alias("aliased"))
    return (
        own.join(aliases, "node", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("aliased"), "block"), F.lit("allow")).alias("verdict"))
    )


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
