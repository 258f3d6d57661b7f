"""URL filters over a sorted digest array.

The keys of a list (host and path prefix, as ``example.com/en/``) are stored as three flat files: the sorted 64-bit
xxhash digests, the offsets of the strings and the strings themselves. Tasks map them into memory, probe a batch of
candidates by one vectorised binary search and compare the stored string of every digest that is found, so a collision
never decides. The files travel with the job (SparkContext.addFile); MOST_KEYS bounds them.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of one list at most: 8 bytes of digest, 8 of offset and the string are shipped for each.
MOST_KEYS = 10_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the production filter (fixed values) and the hosts of its blocklist.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
BLOCKED = tuple(f"{name}.example.{end}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))


class DigestArray:
    """A set of strings as memory-mapped files; ``find`` gives the place of each candidate, -1 if it is not there."""

    def __init__(self, path: str):
        self.digests = np.memmap(path + ".digests", np.uint64, "r") if os.path.getsize(path + ".digests") else np.empty(0, np.uint64)
        self.offsets = np.memmap(path + ".offsets", np.uint64, "r")
        self.strings = np.memmap(path + ".strings", np.uint8, "r") if os.path.getsize(path + ".strings") else np.empty(0, np.uint8)

    @staticmethod
    def write(keys: list[bytes], path: str, digest=xxhash.xxh64_intdigest) -> None:
        if len(keys) > MOST_KEYS:
            raise ValueError(f"a digest array holds {MOST_KEYS} keys at most")
        pairs = sorted({(digest(k), k) for k in keys})
        np.array([d for d, _ in pairs], np.uint64).tofile(path + ".digests")
        np.cumsum([0, *(len(k) for _, k in pairs)], dtype=np.uint64).tofile(path + ".offsets")
        with open(path + ".strings", "wb") as file:
            file.writelines(k for _, k in pairs)

    def string(self, at: int) -> bytes:
        return self.strings[int(self.offsets[at]) : int(self.offsets[at + 1])].tobytes()

    def find(self, candidates: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        wanted = np.fromiter(map(digest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.digests, wanted)
        out = np.full(len(candidates), -1, np.int64)
        for k in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted) if len(self.digests) else ():
            i = int(at[k])
            while i < len(self.digests) and self.digests[i] == wanted[k]:
                if self.string(i) == candidates[k]:
                    out[k] = i
                    break
                i += 1
        return out


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every key that fits a url: its host and parent domains, with the path's beginnings of the lengths in use;
    longest keys first."""
    if not host:
        return []
    parts = host.split(".")
    hosts = [".".join(parts[k:]) for k in range(len(parts))]
    return sorted({h + path[:n] for h in hosts for n in lengths if n <= len(path)}, key=lambda k: (-len(k), k))


def _place(spark: SparkSession, keys: list[str], name: str) -> str:
    """Writes the array of a list on the driver and ships its files; returns their common name."""
    name = f"{name}-{uuid.uuid4().hex}"
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-digests-")), name)
    DigestArray.write([k.encode() for k in keys], path)
    for kind in ("digests", "offsets", "strings"):
        spark.sparkContext.addFile(f"{path}.{kind}")
    return name


def judge(pages: DataFrame, rules: dict[str, str] | None = None, blocked: list[str] | None = None, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    A key ``host/path`` fits its host and all subdomains when the url's path starts with its path; of the rules that
    fit the longest decides. Urls without a rule are blocked when a key of ``blocked`` fits, else allowed. Null urls and
    urls without :// have an empty host and path, no rule, and are allowed. Repeated rows are judged alike; columns of
    pages named like the four new ones are replaced."""
    rules = dict(RULES if rules is None else rules)
    blocked = list(BLOCKED if blocked is None else blocked)
    spark = pages.sparkSession
    rule_files, block_files = _place(spark, list(rules), "rules"), _place(spark, blocked, "blocked")
    lengths = [sorted({len(k) - k.index("/") for k in keys}) for keys in (rules, blocked)]

    @F.pandas_udf("rule string, verdict string")
    def verdicts(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        arrays = [DigestArray(SparkFiles.get(f"{n}.digests").removesuffix(".digests")) for n in (rule_files, block_files)]

        def first(array: DigestArray, hosts: pd.Series, paths: pd.Series, own: list[int]) -> list[str | None]:
            found = [candidates(h, p, own) for h, p in zip(hosts, paths)]
            hit = array.find([k.encode() for keys in found for k in keys]) >= 0
            out, at = [], 0
            for keys in found:
                k = next((i for i in range(len(keys)) if hit[at + i]), None)
                out.append(None if k is None else keys[k])
                at += len(keys)
            return out

        for hosts, paths in columns:
            rule, block = (first(a, hosts, paths, own) for a, own in zip(arrays, lengths))
            verdict = [rules[r] if r is not None else "allow" if b is None else "block" for r, b in zip(rule, block)]
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    url = F.col(f"`{url_col}`").cast("string")
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*rest, host_of(url).alias("host"), path_of(url).alias("path"))
    return parsed.withColumn("_judged", verdicts("host", "path")).select(*parsed.columns, "_judged.rule", "_judged.verdict")


def page_verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{k.partition('/')[0]}', '/{k.partition('/')[2]}', '{v}')" for k, v in RULES.items())
_BLOCK_ROWS = ", ".join(f"('{k.partition('/')[0]}')" for k in BLOCKED)
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r(h, p, v) AS (VALUES {_RULE_ROWS}), b(h) AS (VALUES {_BLOCK_ROWS}),
fit AS (
  SELECT p.page_id, p.host, p.path, r.h || r.p AS rule, r.v FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
), best AS (SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v FROM fit GROUP BY ALL)
SELECT p.page_id, p.host, p.path, best.rule AS rule,
  coalesce(best.v, CASE WHEN EXISTS (SELECT 1 FROM b WHERE (p.host = b.h OR ends_with(p.host, '.' || b.h)) AND starts_with(p.path, '/')) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON p.page_id = best.page_id AND p.host = best.host AND p.path = best.path
"""
