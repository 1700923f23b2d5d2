"""Geometry of words and boxes as relational plans, and drawing descriptions read to parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: phrases of part descriptions and the types they stand for
SPINE = {
    "ROUTED POST": "post", "POST": "post", "ROUTED RAIL": "rail", "DECO RAIL": "rail", "ACCENT RAIL": "rail", "RAIL": "rail", "HORIZONTAL BEAM": "rail",
    "TONGUE AND GROOVE PICKET": "picket", "RIBBED PICKET": "picket", "PICKETS": "picket", "PICKET": "picket", "SET SCREWS": "fastener", "SET SCREW": "fastener", "SCREWS": "fastener", "SCREW": "fastener",
    "ALUMINUM CHANNEL": "post_stiffener_aluminum", "HOURGLASS G-60 STEEL CHANNEL": "post_stiffener_aluminum", "U-SHAPED G-60 STEEL CHANNEL": "post_stiffener_aluminum", "U-SHAPPED G-60 STEEL CHANNEL": "post_stiffener_aluminum",
}
NUM = r'(?:\d+\s+\d+/\d+|\d+/\d+|\d*\.\d+|\d+)"?'


def overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def union_box(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def outside_regions(boxes: DataFrame, regions: DataFrame, page: str, identity: str, share: float = 0.6) -> DataFrame:
    """Boxes of which no more than `share` lies in any region of their page."""
    a = {c: F.col(f"a.{c}") for c in ("x0", "y0", "x1", "y1")}
    b = {c: F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1")}
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    inside = boxes.alias("a").join(regions.alias("b"), F.col(f"a.{page}") == F.col(f"b.{page}")).filter(overlap_area(a, b) > area * share)
    return boxes.join(inside.select(F.col(f"a.{identity}").alias(identity)).distinct(), identity, "left_anti")


def nearest_below(captions: DataFrame, figures: DataFrame, page: str, caption: str, figure: str, reach: float = 40) -> DataFrame:
    """(caption, figure): each caption's nearest figure above it that it overlaps sideways, less than `reach` away."""
    j = captions.alias("c").join(figures.alias("f"), page)
    gap = F.col("c.y0") - F.col("f.y1")
    j = j.filter((F.least("c.x1", "f.x1") > F.greatest("c.x0", "f.x0")) & (gap >= 0) & (gap < reach))
    return j.groupBy(F.col(f"c.{caption}").alias(caption)).agg(F.min_by(F.col(f"f.{figure}"), F.struct(gap, F.col(f"f.{figure}"))).alias(figure))


def numbered_pairs(glyphs: DataFrame, bodies: DataFrame, page: str, window: float = 20) -> DataFrame:
    """(glyph, body): each number's body right of it with the nearest top (ties: the upper), one body a number."""
    j = glyphs.alias("g").join(bodies.alias("b"), page).filter((F.col("b.x0") >= F.col("g.x1")) & (F.abs(F.col("b.y0") - F.col("g.y0")) <= window))
    return j.groupBy(F.col("g.id").alias("glyph")).agg(F.min_by(F.col("b.id"), F.struct(F.abs(F.col("b.y0") - F.col("g.y0")), F.col("b.y0"), F.col("b.id"))).alias("body"))


def cluster_rows(words: DataFrame, page: str, tol: float = 8.0) -> DataFrame:
    """words with a row number: by vertical centre, a word within `tol` of its row's first word joins it.

    The anchor is the row's first word, so the scan of a page's words is sequential; pages are independent.
    """
    schema = words.schema

    def run(pdf):
        pdf = pdf.assign(_c=(pdf["y0"] + pdf["y1"]) / 2).sort_values(["_c", "x0"])
        rows, anchor, n = [], None, -1
        for c in pdf["_c"]:
            if anchor is None or c - anchor > tol:
                anchor, n = c, n + 1
            rows.append(n)
        return pdf.assign(row=rows).drop(columns="_c")[[*schema.names, "row"]]

    return words.groupBy(page).applyInPandas(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in schema], "row int"]))


def column_edges(words: DataFrame, page: str, width: float = 14.0, least: int = 3) -> DataFrame:
    """(page, edge, rows): left edges, in bins of `width`, that recur in `least` rows and a third of the page's rows."""
    b = words.groupBy(page, (F.round(F.col("x0") / width) * width).alias("edge")).agg(F.count_distinct("row").alias("rows"))
    n = words.groupBy(page).agg(F.count_distinct("row").alias("all_rows"))
    return b.join(n, page).filter((F.col("rows") >= least) & (F.col("rows") >= F.col("all_rows") / 3)).select(page, "edge", "rows")


def nearest_column(words: DataFrame, edges: DataFrame, page: str, identity: str) -> DataFrame:
    j = words.join(edges, page)
    return j.groupBy(page, identity).agg(F.min_by("edge", F.struct(F.abs(F.col("x0") - F.col("edge")), "edge")).alias("edge"))


def looks_tabular(cells: DataFrame, by: list[str]) -> DataFrame:
    """Whether a grid of cells is a table: two rows and columns, filled to a third, short cells, few words cut off."""
    full = F.trim(F.coalesce("text", F.lit(""))) != ""
    g = cells.groupBy(*by).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.count_if(full).alias("filled"), F.expr("percentile(case when trim(coalesce(text, '')) <> '' then length(trim(text)) end, 0.5)").alias("median"), F.count_if(full & F.col("text").rlike(r"^[a-z]")).alias("cut"))
    ok = (F.col("rows") >= 2) & (F.col("cols") >= 2) & (F.col("filled") / (F.col("rows") * F.col("cols")) >= 0.35) & (F.col("median") <= 40) & (F.col("cut") / F.greatest(F.lit(1), F.col("filled")) <= 0.25)
    return g.select(*by, F.coalesce(ok, F.lit(False)).alias("tabular"))


def body_size(lines: DataFrame, by: list[str]) -> DataFrame:
    """The line height most characters are set in (ties: the smaller)."""
    n = lines.groupBy(*by, F.round("height", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return n.groupBy(*by).agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body_size"))


def heading_levels(lines: DataFrame, sizes: DataFrame, by: list[str], factor: float = 1.15) -> DataFrame:
    """lines with a level: the distinct sizes above the body's, the largest four, are levels 1 to 4; else null."""
    j = lines.join(sizes, by)
    big = j.filter(F.col("height") > F.col("body_size") * factor).select(*by, F.round("height", 1).alias("size")).distinct()
    rank = big.withColumn("level", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col("size").desc()))).filter("level <= 4")
    return j.withColumn("size", F.round("height", 1)).join(rank, [*by, "size"], "left")


def roles(edges: DataFrame) -> DataFrame:
    """(layout, node, role): end, line or corner by the directions that meet at a node of orthogonal edges."""
    e = edges.select("layout", F.col("a").alias("node"), "axis").unionByName(edges.select("layout", F.col("b").alias("node"), "axis"))
    n = e.groupBy("layout", "node").agg(F.count("*").alias("degree"), F.count_distinct("axis").alias("axes"))
    return n.select("layout", "node", F.when(F.col("degree") == 1, "end").when((F.col("degree") == 2) & (F.col("axes") == 1), "line").otherwise("corner").alias("role"))


def parse_description(x: Column) -> Column:
    """struct(pattern, type_phrase, section, length, size, gauge, qualifier) of a part's description: the first of five
    shapes that fits, else the whole is its type; null where only a relation gives the length."""
    y = F.trim(F.regexp_replace(x, r"\s+", " "))
    by = r"\s*[xX]\s*"
    fields = ("pattern", "type_phrase", "section", "length", "size", "gauge", "qualifier")
    shapes = [
        ("gauge", rf"^(#\d+){by}({NUM})\s+(.+)$", {"gauge": 1, "length": 2, "type_phrase": 3}),
        ("section_length", rf"^({NUM}){by}({NUM}){by}({NUM})\s+(.+)$", {"a": 1, "b": 2, "length": 3, "type_phrase": 4}),
        ("section", rf"^({NUM}){by}({NUM})\s+(.+)$", {"a": 1, "b": 2, "type_phrase": 3}),
        ("type_length", rf"^(.+?){by}({NUM})(?:\s+FOR\s+(.+))?$", {"type_phrase": 1, "length": 2, "qualifier": 3}),
        ("size", rf"^({NUM})\s+INCH\s+(.+)$", {"size": 1, "type_phrase": 2}),
    ]
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(c, '"$', "")), F.lit(""))
    none = F.lit(None).cast("string")

    def made(name: str, rx: str, groups: dict[str, int]) -> Column:
        g = {k: plain(F.regexp_extract(y, rx, i)) for k, i in groups.items()}
        if "a" in g:
            g["section"] = F.concat_ws(" X ", g.pop("a"), g.pop("b"))
        g["pattern"] = F.lit(name)
        return F.struct(*[g.get(f, none).alias(f) for f in fields])

    whole = F.struct(*[(F.lit("type_only") if f == "pattern" else y if f == "type_phrase" else none).alias(f) for f in fields])
    out = F.when(F.coalesce(y, F.lit("")) == "", None).when(y.rlike(r"(?i)\bFULL\s+LENGTH\b"), None)
    for name, rx, groups in shapes:
        out = out.when(y.rlike(rx), made(name, rx, groups))
    return out.otherwise(whole)


def spine_type(x: Column) -> Column:
    """The type of the longest known phrase that is the description, starts it or ends it; null where none does."""
    y = F.trim(F.regexp_replace(F.upper(x), r"\s+", " "))
    out = F.lit(None).cast("string")
    for phrase in sorted(SPINE, key=len):
        hit = (y == phrase) | y.endswith(" " + phrase) | y.startswith(phrase + " ")
        out = F.when(hit, SPINE[phrase]).otherwise(out)
    return out


def part_id(parsed: Column, manufacturer: Column) -> Column:
    """namespace/bom-type-dimensions; null without a known type."""
    from ..functions.quantity import magnitude
    from ..functions.text import namespace

    def plain(x: Column) -> Column:
        m = magnitude(F.regexp_replace(x, r"^\.", "0."))
        text = F.regexp_replace(F.regexp_replace((m["num"] / m["den"]).cast("decimal(20,4)").cast("string"), r"0+$", ""), r"\.$", "")
        return F.when(x.isNotNull(), F.translate(text, ".", "-"))

    kind = spine_type(parsed["type_phrase"])
    section = F.when(parsed["section"].isNotNull(), F.concat_ws("x", plain(F.split_part(parsed["section"], F.lit(" X "), F.lit(1))), plain(F.split_part(parsed["section"], F.lit(" X "), F.lit(2)))))
    gauge = F.when(parsed["gauge"].isNotNull(), F.concat(F.lit("no"), F.regexp_replace(parsed["gauge"], "#", "")))
    bits = F.concat_ws("-", kind, gauge, section, plain(parsed["length"]), plain(parsed["size"]))
    return F.when(kind.isNotNull(), F.concat(namespace(manufacturer), F.lit("/bom-"), bits))
