"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for candidates. What tells a live credential from an example is how far
it has spread: the digests of the candidates are counted over distinct repositories and owners
in the whole corpus. A value that many owners carry is a copied example; one that stays with
its owner and looks random is a live-looking credential. Candidates of the wide ``token``
pattern become spans of their own only when they are owner-specific; the named patterns always
are spans.

Only digests and positions leave the scan. Digests are counted in steps that combine before
each shuffle, so a value in a third of all documents is one row per task. Texts are scanned once for
candidates and read once more for the result; those without candidates stay where they are, the
others meet the verdicts of their text, known by its digest.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.operators.bitmap import key_bitmap, with_hits
from tabwarden.llm.common import slices, text_of
from tabwarden.operators.skew import spread_join
from tabwarden.session import persisted_copy

#: In the order in which spans of one start are listed. Fixed patterns of the contract.
KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class Ownership:
    #: A value with at least so many owners, repositories, or different texts is a copied example.
    copied_owners: int = 3
    copied_repositories: int = 5
    copied_documents: int = 20
    #: Bits per character from which a value looks random.
    min_entropy: float = 3.0


def entropy(value: str) -> float:
    """Bits per character of the value's own letter frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def named_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the named patterns, leftmost and non-overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if len(m.group(2)) >= 6:
                found.append((m.start(), m.end(), "assign", m.group(2)))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                found.append((m.start(), m.end(), "access", m.group()))
    for m in _HEX.finditer(text):
        found.append((m.start(), m.end(), "hex", m.group()))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def wide_tokens(text: str, taken, min_entropy: float):
    """Runs of token characters that mix letters and digits, look random and touch no named span."""
    if not _DIGIT.search(text):
        return
    for m in _TOKEN.finditer(text):
        value = m.group()
        if (
            _DIGIT.search(value)
            and re.search("[A-Za-z]", value)
            and all(m.end() <= s[0] or m.start() >= s[1] for s in taken)
            and entropy(value) >= min_entropy + 0.5
        ):
            yield m.start(), m.end(), "owned", value


_CANDIDATES = "array<struct<start:int,end:int,kind:string,digest:string,random:boolean>>"


def _scan(min_entropy: float, passed: list[str]):
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(
            pa.struct(
                [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("digest", pa.string()), ("random", pa.bool_())]
            )
        )
        for batch in slices(batches, 2 << 20, "scanned"):
            out = []
            for text in batch.column("scanned").to_pylist():
                named = named_spans(text)
                out.append(
                    [
                        {
                            "start": start,
                            "end": end,
                            "kind": which,
                            "digest": hashlib.sha256(value.encode()).hexdigest()[:32],
                            "random": entropy(value) >= min_entropy,
                        }
                        for start, end, which, value in (*named, *wide_tokens(text, named, min_entropy))
                    ]
                )
            some = pa.array([bool(candidates) for candidates in out], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in passed] + [pa.array(out, kind)], [*passed, "candidates"]
            ).filter(some)

    return run


def ownership(candidates: DataFrame) -> DataFrame:
    """``digest, owners, repositories, documents``: distinct owners, repositories and texts (in them) of each value."""
    return (
        candidates.groupBy("digest", "owner", "repository", "node")
        .agg(F.lit(1).alias("one"))
        .groupBy("digest", "owner", "repository")
        .agg(F.count("*").alias("in_repository"))
        .groupBy("digest", "owner")
        .agg(F.count("*").alias("in_owner"), F.sum("in_repository").alias("in_repository"))
        .groupBy("digest")
        .agg(F.count("*").alias("owners"), F.sum("in_owner").alias("repositories"), F.sum("in_repository").alias("documents"))
    )


_FOUND = "array<struct<start:int,order:int,end:int,kind:string,digest:string,owners:long,repositories:long,documents:long,verdict:string>>"


def scan_secrets(
    documents: DataFrame,
    rule: Ownership = Ownership(),
    owner: str = "source",
    repository: str = "lang",
    carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per document: the carried columns and ``found``, an array of (start, end, kind, digest,
    owners, repositories, documents, verdict), sorted by start, then kind.

    Null text is empty; null owners and repositories count as one unknown each. A repository is
    named within its owner. Repeated rows stay rows of their own; equal texts of one repository count as one
    document. Positions are code points, ends exclusive. Verdicts: ``copied`` (many owners,
    repositories or documents), ``live`` (few and random-looking), else ``other``. Other columns are
    not looked at.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(
        F.md5(text_of()).alias("node"),
        named(owner).alias("owner"),
        F.concat_ws("/", named(owner), named(repository)).alias("repository"),
        text_of().alias("scanned"),
    )
    schema = f"node string, owner string, repository string, candidates {_CANDIDATES}"
    scanned = rows.mapInArrow(_scan(rule.min_entropy, rows.columns[:-1]), schema)
    scanned = persisted_copy(scanned, "secret-candidates")
    each = scanned.select("node", "owner", "repository", F.explode("candidates.digest").alias("digest"))
    spread = persisted_copy(ownership(each), "secret-owners")
    texts = scanned.groupBy("node").agg(F.first("candidates").alias("candidates"), F.count("*").alias("copies"))
    texts = texts.select("node", "copies", F.explode("candidates").alias("c")).select("node", "copies", "c.*")
    verdict = (
        F.when(
            (F.col("owners") >= rule.copied_owners)
            | (F.col("repositories") >= rule.copied_repositories)
            | (F.col("documents") >= rule.copied_documents),
            "copied",
        )
        .when(F.col("random"), "live")
        .otherwise("other")
    )
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("order"), "end", "kind", "digest", "owners", "repositories", "documents", "verdict")
    judged = (
        spread_join(texts, spread, ["digest"], "documents", "inner")
        .withColumn("verdict", verdict)
        .where("kind != 'owned' OR verdict = 'live'")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(span)).cast(_FOUND).alias("found"), F.max("copies").alias("copies"))
    )
    judged = persisted_copy(judged, "secret-verdicts")
    results = documents.select(*(F.col(c).alias(f"own_{c}") for c in carry), F.md5(text_of()).alias("node"))
    results = with_hits(results, key_bitmap(judged, "node"), "node")
    own, none = [F.col(f"own_{c}").alias(c) for c in carry], F.array().cast(_FOUND)
    clean = results.where("NOT __hit").select(*own, none.alias("found"))
    met = spread_join(results.where("__hit"), judged, ["node"], "copies", "left")
    return clean.unionByName(met.select(*own, F.coalesce("found", none).alias("found")))


def redact(
    scanned: DataFrame, text: str = "text", mark: str = "[secret]", verdicts: tuple[str, ...] = ("live", "copied", "other")
) -> DataFrame:
    """Put a mark in the place of every span of these verdicts in the carried text; ``found`` keeps just these."""
    scanned = scanned.withColumn("found", F.filter("found", lambda s: s["verdict"].isin(*verdicts)))
    # Spans may overlap; what one covers from its start to the furthest end so far goes once.
    ends = F.transform("found", lambda s: s["end"])
    pieces = F.transform(
        "found",
        lambda s, i: F.struct(
            F.when(i == 0, 0).otherwise(F.array_max(F.slice(ends, 1, F.greatest(i, F.lit(1))))).alias("from"),
            s["start"].alias("to"),
        ),
    )
    kept = F.transform(
        F.filter(pieces, lambda p: (p["to"] > p["from"]) | (p["from"] == 0)),
        lambda p: F.substring(F.col(text), p["from"] + 1, p["to"] - p["from"]),
    )
    tail = F.substring(F.col(text), F.array_max(ends) + 1, F.length(text))
    return scanned.withColumn(
        text, F.when(F.size("found") == 0, F.col(text)).otherwise(F.concat(F.array_join(kept, mark), F.lit(mark), tail))
    )


def secret_digests(scanned: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the named spans and all spans as text."""
    found = F.col("found")
    of = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return scanned.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(said(F.filter(found, lambda s: s["kind"] != "owned")), 256).alias("base_sha256"),
        said(found).alias("spans"),
        F.size(F.filter(found, lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter(found, lambda s: s["verdict"] == "copied")).cast("long").alias("n_copied"),
    )
