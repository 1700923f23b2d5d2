"""References, citations, gaps, snapshots and answers from them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_bytes, payload_hash, ref_id, short_sha
from .conditions import check_dimensions


def visible(owner: Column, tenant: str | None) -> Column:
    """Shared rows (no owner) and the tenant's own."""
    return owner.isNull() if tenant is None else owner.isNull() | (owner == tenant)


def check_tenant(name: str) -> str:
    if not name or name != name.strip() or any(c.isspace() for c in name) or name.lower() in ("shared", "public", "none", "null", "all"):
        raise ValueError(f"not a tenant name: {name!r}")
    return name


def reference_index(elements: DataFrame) -> DataFrame:
    """(ref_id, sha256, page_no, element_ids): a place on a page of one file, and the elements there."""
    r = elements.withColumn("ref_id", ref_id(F.col("sha256"), F.col("page_no"), F.col("bbox")))
    return r.groupBy("ref_id", "sha256", "page_no").agg(F.array_sort(F.collect_set("element_id")).alias("element_ids"))


def citation_faults(cites: DataFrame, index: DataFrame, versions: DataFrame) -> DataFrame:
    """(cite, fault): ok, dangling, unknown_version or mismatched_owner of each citation (ref_id, sha256, owner)."""
    i = index.select("ref_id", F.col("sha256").alias("held")).distinct()
    v = versions.select("sha256", F.col("document_id").alias("filed")).groupBy("sha256").agg(F.collect_set("filed").alias("filed"))
    j = cites.join(i, "ref_id", "left").join(v, "sha256", "left")
    fault = F.when(F.col("filed").isNull(), "unknown_version").when(F.col("held").isNull(), "dangling").when((F.col("held") != F.col("sha256")) | ~F.array_contains("filed", F.col("owner")), "mismatched_owner").otherwise("ok")
    return j.select("cite", fault.alias("fault"))


def uncited(values: DataFrame, sources: DataFrame, cites: str, on: str) -> DataFrame:
    """Citations that belong to no source of the snapshot."""
    return values.select(F.explode(cites).alias(on)).distinct().join(sources.select(on).distinct(), on, "left_anti")


def gaps(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each gap (kind, subject, code) once, as first reported in an order, named by its content."""
    first = rows.groupBy("kind", "subject", "code").agg(F.min_by("note", F.struct(*order)).alias("note"))
    return first.withColumn("gap_id", short_sha(F.concat_ws("|", "kind", "subject", "code")))


def filings(versions: DataFrame) -> DataFrame:
    """(sha256, filings): every document that a content is filed under, in order."""
    return versions.groupBy("sha256").agg(F.array_sort(F.collect_set("document_id")).alias("filings"))


def successors(relations: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_id, successor contents): of the documents that replace it."""
    j = relations.filter("relation = 'superseded_by'").join(versions.select(F.col("document_id").alias("to_id"), "sha256"), "to_id")
    return j.groupBy(F.col("from_id").alias("document_id")).agg(F.array_sort(F.collect_set("sha256")).alias("successors"))


def shared_marks(passages: DataFrame, values: DataFrame) -> DataFrame:
    """passages with the values that cite their document."""
    by = values.groupBy("document_id").agg(F.array_sort(F.collect_set("value_id")).alias("cited_by"))
    return passages.join(by, "document_id", "left").withColumn("cited_by", F.coalesce("cited_by", F.expr("cast(array() as array<string>)")))


# ---- snapshots: small published documents, on the driver

KINDS = ("missing", "ambiguous", "conflict", "unread", "unmapped", "quality")


@dataclass
class Snapshot:
    """A payload of JSON lists, written once under its own hash."""

    payload: dict = field(default_factory=dict)

    @property
    def id(self) -> str:
        return payload_hash(self.payload, without="snapshot_id")

    def faults(self) -> list[str]:
        """What keeps it from being published: duplicate names, kinds not known, citations without a source."""
        out = []
        for member, rows in self.payload.items():
            if isinstance(rows, list):
                names = [r["id"] for r in rows if isinstance(r, dict) and "id" in r]
                out += [f"{member}: {n} twice" for n in sorted({n for n in names if names.count(n) > 1})]
        known = {s["id"] for s in self.payload.get("source_docs", [])}
        for member in ("parameters", "warnings", "procedures"):
            for r in self.payload.get(member, []):
                out += [f"{member}: {r.get('id')} cites {c}" for c in r.get("cites", []) if c not in known]
        out += [f"gaps: kind {g.get('kind')}" for g in self.payload.get("gaps", []) if g.get("kind") not in KINDS]
        return out


class SnapshotStore:
    """Content-addressed JSON files in a folder that Spark's file system reaches; none is ever written over."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}.json")

    def put(self, snapshot: Snapshot) -> str:
        if faults := snapshot.faults():
            raise ValueError("; ".join(faults))
        name = snapshot.id
        if not self._fs.exists(self._at(name)):
            self._write(name, canonical_bytes(snapshot.payload))
        return name

    def _write(self, name: str, data: bytes) -> None:
        out = self._fs.create(self._at(name), False)
        try:
            out.write(data)
        finally:
            out.close()

    def get(self, name: str) -> dict:
        text = self.spark.read.text(f"{self.folder}/{name}.json", wholetext=True).first()
        return json.loads(text["value"])

    def list(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        return sorted(s.getPath().getName().removesuffix(".json") for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName().endswith(".json"))

    def tombstone(self, name: str, reason: str) -> None:
        """The name stays, its content goes, and why is kept."""
        self._fs.delete(self._at(name), False)
        self._write(name, canonical_bytes({"tombstone": True, "reason": reason, "snapshot_id": name}))

    def verify(self) -> dict[str, str]:
        """ok, tombstone or corrupt, by name."""
        out = {}
        for name in self.list():
            payload = self.get(name)
            out[name] = "tombstone" if payload.get("tombstone") else "ok" if payload_hash(payload, without="snapshot_id") == name else "corrupt"
        return out


def answer(payload: dict, stated: dict, scope: dict | None = None) -> dict:
    """Values of a pinned snapshot that apply to a situation, conflicts beside them; nothing is resolved."""

    def plain(v: object) -> str:
        text = str(v).strip().lower()
        try:
            return repr(float(text))
        except ValueError:
            return text

    tables = payload.get("parameter_tables", [])
    check_dimensions(stated, {d for t in tables for d in t.get("domain", {})})
    found, unstated, outside = [], set(), set()
    for t in tables:
        verdicts: dict[str, list[bool]] = {}
        for row in t["rows"]:
            keys = {k: (plain(stated[k]) == plain(v) if k in stated else None) for k, v in row["conditions"].items()}
            for k, ok in keys.items():
                if ok is not None:
                    verdicts.setdefault(k, []).append(ok)
            if False in keys.values():
                continue
            missing = sorted(k for k, ok in keys.items() if ok is None)
            unstated |= set(missing)
            match = "not_requested" if scope is None else "exact" if t.get("scope") == scope else "other"
            found.append({"parameter": t["parameter"], "value": row["value"], "authority": row.get("authority"), "scope": match, "unstated": missing})
        outside |= {(t["parameter"], k) for k, oks in verdicts.items() if not any(oks)}
    by: dict[str, set] = {}
    for f in found:
        by.setdefault(f["parameter"], set()).add(json.dumps(f["value"], sort_keys=True))
    return {"values": found, "conflicts": sorted(p for p, v in by.items() if len(v) > 1), "unstated": sorted(unstated), "outside": sorted(outside)}


def required(payload_or_id: object, other: object) -> None:
    """Exactly one way to name the snapshot: the query never picks one."""
    if (payload_or_id is None) == (other is None):
        raise ValueError("name one snapshot, by its payload or by its id")
