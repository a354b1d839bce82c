"""robots.txt: parsing, matching, status policy and time to live."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longest crawl delay in seconds and how long a robots file is believed.
MAX_DELAY, TTL_HOURS = 300.0, 24
SCHEMA = "rules array<struct<path:string,allow:boolean>>, delay double, sitemaps array<string>"


@dataclass
class Robots:
    rules: list[tuple[str, bool]] = field(default_factory=list)
    delay: float | None = None
    sitemaps: list[str] = field(default_factory=list)

    def allows(self, path: str) -> bool:
        """The longest matching pattern decides, allowing wins a tie, no match allows."""
        hits = [(len(p.encode()), allow) for p, allow in self.rules if re.match(pattern_regex(p), path)]
        return max(hits)[1] if hits else True


ALLOW_ALL, DENY_ALL = Robots(), Robots(rules=[("/", False)])


def pattern_regex(pattern: str) -> str:
    """Regex of a path pattern; each ``*`` goes to the first match of what follows and is not tried again."""
    closed = pattern.endswith("$")
    pieces = (pattern[:-1] if closed else pattern).split("*")
    # lazily up to the next piece, in an atomic group
    out = "^" + re.escape(pieces[0]) + "".join(f"(?>.*?{re.escape(p)})" if p else "" for p in pieces[1:])
    return out + ("" if not closed else ".*$" if len(pieces) > 1 and not pieces[-1] else "$")


def parse(text: str, agent: str) -> Robots:
    """Rules of the one group that fits ``agent`` best: the longest name that starts it, of equal ones the later."""
    agent = agent.lower()
    groups: list[dict] = []
    sitemaps, naming = [], False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap":
            if value:
                sitemaps.append(value)
        elif key == "user-agent":
            if not naming:
                groups.append({"names": [], "rules": [], "delay": None})
            groups[-1]["names"].append(value.lower())
            naming = True
        elif key in ("allow", "disallow", "crawl-delay"):  # fields that aren't known leave a group open
            naming = False
            if groups and key != "crawl-delay" and value:
                groups[-1]["rules"].append((value, key == "allow"))
            elif groups and key == "crawl-delay":
                try:
                    seconds = float(value)
                except ValueError:
                    continue
                if math.isfinite(seconds) and seconds >= 0:
                    groups[-1]["delay"] = min(seconds, MAX_DELAY)
    best, chosen = -1, None
    for g in groups:
        fits = max((0 if n == "*" else len(n) for n in g["names"] if n == "*" or n and agent.startswith(n)), default=-1)
        if fits >= 0 and fits >= best:
            best, chosen = fits, g
    return Robots(chosen["rules"], chosen["delay"], sitemaps) if chosen else Robots(sitemaps=sitemaps)


def parse_column(text: Column, agent: str) -> Column:
    """STRUCT<rules, delay, sitemaps> of robots texts, one row per host."""

    @F.pandas_udf(SCHEMA)
    def run(s: pd.Series) -> pd.DataFrame:
        made = [parse(t or "", agent) for t in s]
        return pd.DataFrame({"rules": [[{"path": p, "allow": a} for p, a in m.rules] for m in made], "delay": pd.array([m.delay for m in made], "Float64").astype("object"), "sitemaps": [m.sitemaps for m in made]})

    return run(text)


def by_status(status: Column, parsed: Column) -> Column:
    """2xx is believed, 4xx allows everything, anything else denies everything."""
    none = F.lit(None).cast("double")
    nothing = F.array().cast("array<string>")
    rule = F.array(F.struct(F.lit("/").alias("path"), F.lit(False).alias("allow")))
    allow = F.struct(F.slice(rule, 1, 0).alias("rules"), none.alias("delay"), nothing.alias("sitemaps"))
    deny = F.struct(rule.alias("rules"), none.alias("delay"), nothing.alias("sitemaps"))
    return F.when(status.between(200, 299), parsed).when(status.between(400, 499), allow).otherwise(deny)


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``allowed``; ``rules`` holds (host, path, allow) with the pattern in path (C4).

    Rules are gathered per host, so a host's URLs aren't multiplied by its rules.
    """
    rows = rules.select(F.col("host"), F.struct(F.octet_length("path").alias("size"), F.col("allow"), pattern_column(F.col("path")).alias("regex")).alias("rule"))
    per_host = rows.groupBy("host").agg(F.sort_array(F.collect_set("rule"), asc=False).alias("_rules"))
    first = F.try_element_at(F.filter("_rules", lambda r: F.rlike(F.col("path"), r["regex"])), F.lit(1))["allow"]
    return urls.join(per_host, "host", "left").withColumn("allowed", F.coalesce(first, F.lit(True))).drop("_rules")


def pattern_column(path: Column) -> Column:
    """:func:`pattern_regex` as a column expression."""
    closed = path.endswith("$")
    body = F.when(closed, path.substr(F.lit(1), F.length(path) - 1)).otherwise(path)
    pieces = F.split(body, r"\*", -1)
    quoted = F.transform(pieces, lambda p: F.regexp_replace(p, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1"))
    rest = F.slice(quoted, 2, F.greatest(F.size(quoted) - 1, F.lit(0)))
    middle = F.array_join(F.transform(rest, lambda p: F.when(p == "", "").otherwise(F.concat(F.lit("(?>.*?"), p, F.lit(")")))), "")
    open_end = (F.size(quoted) > 1) & (F.element_at(quoted, -1) == "")
    return F.concat(F.lit("^"), F.element_at(quoted, 1), middle, F.when(closed, F.when(open_end, ".*$").otherwise("$")).otherwise(""))


def known_until(answers: DataFrame, now: Column, hours: int = TTL_HOURS) -> DataFrame:
    """The newest answer of each host if it is younger than ``hours`` (C6); needs host and learned_at."""
    others = [c for c in answers.columns if c not in ("host", "learned_at")]
    newest = answers.groupBy("host").agg(F.max(F.struct("learned_at", *others)).alias("_a")).select("host", "_a.*")
    return newest.where(F.col("learned_at") > now - F.expr(f"INTERVAL {hours} HOURS"))
