"""Names inherited down a page or a file: models of merged cells, rows corrected from below, families, lines above a price.

Rows have file, page, item (a key), y, x, modelo, variante, fob; order on a page is y, x, item (nulls first). Null names are
empty, null files or pages are groups of their own; other columns are ignored. Pages are read by windows, which spill; files
of any size are cut into blocks of their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.text import usd_price
from lonja.operators.ranks import ranked

PAGE = ["file", "page"]
#: Lines looked back and kept above a price, characters of a name, rows of a block of a file's order.
BACK, KEPT, CHARS, BLOCK = 8, 5, 80, 50_000
#: Rows looked back for a family, longest name that looks for one, a base must be longer, its core must be longer.
FAMILY, SHORT, BASE, CORE = 3, 18, 15, 8
#: Prices this near are equal; a merged cell reaches so many row heights down; the height of a page without gaps.
CENT, REACH, HEIGHT = 0.01, 1.5, 60.0
# Words of names that are a colour, specifications, noise or a column's title.
COLOURS = "transparent|black|white|pink|blue|red|green|purple|grey|gray|silver|gold|orange|brown|cyan|magenta|yellow|coffee|cream|berry|mint|navy|teal|beige|ivory|charcoal|rose|slate|olive|maroon|aqua|violet|indigo|peach|sky|jade|amber|coral|mocha|latte"
SPEC = r"tri|mode|charging|charge|dock|wireless|wired|bluetooth|mechanical|magnetic|carbon|fiber|rapid|trigger|hall|effect|ice|axis|switch|keycap|engraving|gradient|screen|display|paw\d\w*|with|and|total|bottoming|\d+(\.\d+)?(k|khz|ghz|mhz|hz|dpi|g|mm|%|mah|mv|db)"
CODE = r"(^|[\s-])(?!paw\d)[A-Za-z]{1,6}\d{1,4}[\w+]*"
LOUD = "items?|ceased|released|production|those|small|only|new|upcoming|total|the"
FAMILY_COLOURS = "pink|green|purple|orange|coffee|white|black|grey|gray|blue|red|cyan|teal|brown|mint|navy|lavender|coral|yellow|cream|silver|gold|wukong"
FAMILY_ALONE = FAMILY_COLOURS + "|dark blue|transparent|clear|matte|glossy"
TITLES = "model|product|picture|image|switch|color|colour|axis|wired|wireless|cny|rmb|usd|price|remark|note|cnyhot"
NOISE = [r"^[一-鿿\s]+$", r"(?i)zhengzhou|damulin", r"^[\d\s.,-]+$", rf"(?i)^({TITLES})$", r"^[¥￥]\s*[\d,]", r"^\d{13}$", r"(?i)^RZ\d{2}-[\dA-Z-]+$"]
LONGEST_LINE = 120
BLOCK_TITLES = "model|color|price|image|picture|spec|remark|moq|fob|cny|rmb|usd"


def spec_only(model: Column) -> Column:
    """Whether a name has no code and all its words are specifications."""
    t = F.trim(F.coalesce(model, F.lit("")))
    words = F.filter(F.split(F.lower(t), r"[\s\-+/]+"), lambda w: w != "")
    joined = F.array_join(words, "")
    return (F.size(words) > 0) & ~t.rlike(f"(?i){CODE}") & (joined.rlike(r"^paw\d\w*$") | F.forall(words, lambda w: w.rlike(f"^({SPEC})$")))


def _down() -> Window:
    return Window.partitionBy(*PAGE).orderBy("y", "x", "item")


def carried(rows: DataFrame, clean: Callable[[Column], Column] = lambda name: name) -> DataFrame:
    """rows (file, page, item, y, x, fob) with modelo, variante, ``kind``, ``blank`` (no name of its own) and ``from_fob``.

    A bare row (no name, a note in brackets, a colour, specifications) takes the name that holds at its place: "inherited".
    Where none holds or it is noise, it takes its variant for a name ("swap"), else keeps its own ("own"); with neither it is
    no product ("none"). Names of at least three characters hold for the rows below, swaps never. from_fob: the price of the
    row above that last had the name, for inherited rows. ``clean`` may tidy names. Windows of one partitioning: one shuffle."""
    raw, variant = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("modelo", "variante"))
    above = _down().rowsBetween(Window.unboundedPreceding, -1)
    named = rows.select(*PAGE, "item", "y", "x", "fob", raw.alias("_raw"), variant.alias("_variant")).withColumn("_name", F.when(F.col("_raw").startswith("("), "").otherwise(clean(F.col("_raw"))))
    name = F.col("_name")
    bare = F.col("_raw").startswith("(") | (F.col("_raw") == "") | spec_only(F.col("_raw")) | F.col("_raw").rlike(f"(?i)^({COLOURS})$")
    valid = (F.length(name) > 2) & ~F.lower(name).isin("item", "producto")
    flagged = named.withColumns({"_bare": bare, "_valid": valid, "_loud": name.rlike(rf"(?i)\b({LOUD})\b")})
    head = ~F.col("_bare") & F.col("_valid")
    placed = flagged.withColumns({"_heads": F.coalesce(F.sum(F.when(head, 1)).over(above), F.lit(0)), "_head": F.last(F.when(head, F.struct(name, F.col("_loud"))), ignorenulls=True).over(above)})
    spare = F.col("_bare") & F.col("_valid") & ~F.col("_loud") & (F.col("_variant") == "")
    since = Window.partitionBy(*PAGE, "_heads").orderBy("y", "x", "item").rowsBetween(Window.unboundedPreceding, -1)
    holds = F.when(~F.col("_head._loud"), F.col("_head._name")).otherwise(F.first(F.when(spare, name), ignorenulls=True).over(since))
    held = placed.withColumn("_holds", holds)
    kind = F.when(~F.col("_bare"), "own").when(F.col("_holds").isNotNull(), "inherited").when(F.col("_variant") != "", "swap").when(name != "", "own").otherwise("none")
    out = held.withColumn("kind", kind)
    sets = (F.col("kind") == "inherited") | ((F.col("kind") == "own") & F.col("_valid"))
    price = F.last(F.when(sets, F.struct("fob")), ignorenulls=True).over(above)["fob"]
    modelo = F.when(F.col("kind") == "inherited", F.col("_holds")).when(F.col("kind") == "swap", clean(F.col("_variant"))).otherwise(name)
    return out.select(*PAGE, "item", "y", "x", "fob", "kind", (F.col("_raw") == "").alias("blank"), modelo.alias("modelo"), F.col("_variant").alias("variante"), F.when(F.col("kind") == "inherited", price).alias("from_fob"))


def filled(rows: DataFrame) -> DataFrame:
    """Rows of carried() without "none": swaps of rows without a name take the name of the row with a name of its own that
    follows the last of them (null ``filled`` for other rows); their variant loses the words of the swapped name."""
    below = _down().rowsBetween(1, Window.unboundedFollowing)
    rows = rows.where("kind <> 'none'")
    waits = (F.col("kind") == "swap") & F.col("blank")
    end = F.first(F.when(~waits, F.struct((~F.col("blank") & (F.col("kind") != "swap")).alias("gives"), F.col("modelo").alias("name"))), ignorenulls=True).over(below)
    name = F.when(waits & F.col("_end.gives"), F.col("_end.name"))
    used = F.split(F.lower("modelo"), r"\s+")
    left = F.array_join(F.filter(F.split("variante", r"\s+"), lambda w: ~F.array_contains(used, F.lower(w))), " ")
    ended = rows.withColumns({"_end": end, "variante": F.when(waits, left).otherwise(F.col("variante"))})
    columns = [c for c in rows.columns if c not in ("modelo", "variante")]
    return ended.select(*columns, F.coalesce(name, F.col("modelo")).alias("modelo"), "variante", name.alias("filled"))


def fused(rows: DataFrame, heights: DataFrame) -> DataFrame:
    """Rows of filled() with the name of the merged cell below: an inherited row whose price is not that of the name above takes
    the name of the first row below with its price and a name not inherited, at most REACH row heights down (null ``fused`` for
    other rows, and for equal names). heights: file, page, height (null or missing: HEIGHT). Rows without a price or place stay.

    Only such rows meet the named rows of three price steps around their own, on their page and within reach."""
    step = F.floor(F.col("fob") / CENT)
    away = rows.where((F.col("kind") == "inherited") & (F.abs(F.col("fob") - F.col("from_fob")) >= CENT)).join(_renamed(heights.select(*PAGE, "height"), "h"), _same_page("h"), "left")
    asks = away.select(*PAGE, "item", "y", "x", "fob", "modelo", F.coalesce("height", F.lit(HEIGHT)).alias("height"), F.explode(F.array(step - 1, step, step + 1)).alias("_step")).alias("a")
    gives = _renamed(rows.where((F.col("kind") != "inherited") & F.col("y").isNotNull()).select(*PAGE, "y", "x", "item", "fob", "modelo", step.alias("_step")), "g")
    later = F.struct("g_y", "g_x", "g_item") > F.struct("y", "x", "item")
    near = _same_page("g") & (F.col("_step") == F.col("g__step")) & (F.abs(F.col("g_fob") - F.col("fob")) <= CENT) & later & (F.col("g_y") - F.col("y") <= F.col("height") * REACH)
    first = asks.join(gives, near).groupBy(*PAGE, "item", "modelo").agg(F.min(F.struct("g_y", "g_x", "g_item", "g_modelo"))["g_modelo"].alias("name"))
    found = first.where((F.col("name") != "") & (F.col("name") != F.col("modelo"))).select(F.col("item").alias("_item"), F.col("name").alias("fused"))
    columns = [c for c in rows.columns if c != "modelo"]
    return rows.join(found, F.col("item") == F.col("_item"), "left").select(*columns, F.coalesce("fused", "modelo").alias("modelo"), "fused")


def _renamed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{prefix}_{c}" if c != "height" else c) for c in rows.columns))


def _same_page(prefix: str) -> Column:
    return F.col("file").eqNullSafe(F.col(f"{prefix}_file")) & F.col("page").eqNullSafe(F.col(f"{prefix}_page"))


def _noise(text: Column) -> Column:
    found = (F.length(text) < 2) | (F.length(text) > LONGEST_LINE)
    for pattern in NOISE:
        found = found | text.rlike(pattern)
    return found


def row_context(lines: DataFrame) -> DataFrame:
    """(file, page, item, modelo, variante): names of the lines (file, page, y, item, text) with a dollar price, read down the
    pages of a file. Of the BACK lines before, down from the last line with a price, KEPT that are not noise count: the highest
    names the model, the others and what is left of the line itself the variant. Lines that give no model are left out; null
    texts are empty lines.

    A file's lines are ranked and cut into blocks; the last lines of a block go to the next one too."""
    lines = lines.select(*PAGE, "y", "item", F.coalesce("text", F.lit("")).alias("text"))
    own = ranked(lines, ["file"], [F.col("page"), F.col("y"), F.col("item")], "_rank")
    block = F.floor((F.col("_rank") - 1) / BLOCK)
    sent = F.when((F.col("_rank") - 1) % BLOCK >= BLOCK - BACK, F.array(block, block + 1)).otherwise(F.array(block))
    copies = own.withColumn("_block", F.explode(sent)).withColumns({"_own": F.col("_block") == block, "_price": usd_price(F.col("text")).isNotNull()})
    before = Window.partitionBy("file", "_block").orderBy("_rank").rowsBetween(-BACK, -1)
    seen = copies.withColumn("_before", F.collect_list(F.struct("_price", "text", _noise(F.col("text")).alias("noise"))).over(before)).where("_price AND _own")
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))

    def read(state: Column, line: Column) -> Column:
        done = state["done"] | line["_price"]
        kept = F.when(done | line["noise"] | (F.size(state["kept"]) >= KEPT), state["kept"]).otherwise(F.concat(F.array(line["text"]), state["kept"]))
        return F.struct(done.alias("done"), kept.alias("kept"))

    kept = F.aggregate(F.reverse("_before"), start, read)["kept"]
    bare = F.trim(F.regexp_replace(F.regexp_replace("text", r"[¥￥]\s*[\d,]+\.?\d*", ""), r"(?<![¥￥])\$\s*[\d,]+\.?\d*", ""))
    inline = F.when(_noise(bare), "").otherwise(F.trim(F.regexp_replace(bare, r"[-\s]+$", "")))
    named = seen.select(*PAGE, "item", kept.alias("kept"), inline.alias("inline"))
    above = F.size("kept") > 0
    model = F.trim(F.substring(F.when(above, F.get("kept", F.lit(0))).otherwise(F.col("inline")), 1, CHARS))
    rest = F.filter(F.concat(F.slice("kept", 2, KEPT), F.array("inline")), lambda t: t != "")
    variant = F.when(above, F.substring(F.trim(F.regexp_replace(F.array_join(rest, " "), r"\s+", " ")), 1, CHARS)).otherwise("")
    return named.select(*PAGE, "item", model.alias("modelo"), variant.alias("variante")).where("modelo <> ''")


def families(rows: DataFrame, by: tuple[str, ...] = ("marca", "cat")) -> DataFrame:
    """(file, page, item, modelo, variante, base): a short name of colours or letters only becomes the variant of its family: of
    the FAMILY rows before it in its file with the same ``by``, as they came out, the nearest with a long name that is no
    colour gives its name without colours, if enough is left. All rows count as accepted, repeated ones too.

    Each group's rows are ranked and cut into blocks. A block whose FAMILY rows before are no such names starts afresh, since those
    rows come out as they are; blocks that do not are read on with the block before. A segment streams through a task in order, which
    holds the last FAMILY rows only."""
    by = list(by)
    alone = rf"(?i)^({FAMILY_ALONE})[\s\-.]*$"
    rows = rows.select(*dict.fromkeys([*PAGE, "item", "y", "x", *by]), F.coalesce("modelo", F.lit("")).alias("modelo"), F.coalesce("variante", F.lit("")).alias("variante"))
    name = F.trim("modelo")
    core = F.trim(F.regexp_replace(F.regexp_replace("modelo", rf"(?i)\b({FAMILY_COLOURS})\b", ""), r"\s+", " "))
    asks = (F.length(name) <= SHORT) & (name.rlike(alone) | name.rlike(r"(?i)^[a-z\s-]+$"))
    is_base = (F.length("modelo") > BASE) & ~name.rlike(alone)
    flagged = rows.withColumns({"_asks": asks, "_core": F.when(is_base, core)}).withColumn("_keeps", F.coalesce((F.length("_core") > BASE) & ~F.col("_core").rlike(alone), F.lit(False)))
    group = ["file", *by]
    own = ranked(flagged, group, [F.col("page"), F.col("y"), F.col("x"), F.col("item")], "_rank")
    own = own.withColumn("_block", F.floor((F.col("_rank") - 1) / BLOCK))
    last = F.col("_rank") > (F.col("_block") + 1) * BLOCK - FAMILY
    blocks = own.groupBy(*group, "_block").agg(F.coalesce(F.bool_or(F.when(last, F.col("_asks"))), F.lit(False)).alias("_runs"))
    in_order = Window.partitionBy(*group).orderBy("_block")
    segments = blocks.withColumn("_segment", F.sum(F.when(F.lag("_runs", 1, False).over(in_order), 0).otherwise(1)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    segments = segments.withColumns({"_next": F.lead("_segment").over(in_order)}).select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_block").alias("_b"), "_segment", "_next")
    same = own["_block"] == segments["_b"]
    for g in group:
        same = same & own[g].eqNullSafe(segments[f"_{g}"])
    to = F.when(last & (F.col("_next") > F.col("_segment")), F.array(F.struct(F.col("_segment").alias("s"), F.lit(True).alias("own")), F.struct(F.col("_next").alias("s"), F.lit(False).alias("own"))))
    sent = own.join(segments, same).select(*own.columns, F.explode(F.coalesce(to, F.array(F.struct(F.col("_segment").alias("s"), F.lit(True).alias("own"))))).alias("_to"))
    keyed = sent.select(*own.columns, F.col("_to.own").alias("_own"), F.struct(*group, F.col("_to.s").alias("s")).alias("_key"))
    keyed = keyed.withColumn("_key", F.to_json("_key", {"ignoreNullFields": "false"}))
    ordered = keyed.repartition("_key").sortWithinPartitions("_key", "_rank")
    schema = ordered.select(*rows.columns).schema.add("base", "string")
    read = ordered.mapInArrow(_families(rows.columns), schema)
    inherits = F.col("base").isNotNull()
    variant = F.when(inherits, F.trim(F.concat_ws(" ", name, F.when(F.col("variante") != "", F.col("variante"))))).otherwise(F.col("variante"))
    return read.select(*PAGE, "item", F.coalesce("base", "modelo").alias("modelo"), variant.alias("variante"), "base")


def _families(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, past = None, []
        for batch in batches:
            bases = []
            for k, asks, core, keeps in zip(*(batch.column(c).to_pylist() for c in ("_key", "_asks", "_core", "_keeps"))):
                if k != key:
                    key, past = k, []
                nearest = next((p for p in reversed(past) if p[0] is not None), None) if asks else None
                base = nearest[0] if nearest and len(nearest[0]) > CORE else None
                came_out = (core, keeps) if base is None else (base if nearest[1] else None, nearest[1])
                past = [*past, came_out][-FAMILY:]
                bases.append(base)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(bases, pa.string())], [*columns, "base"])
            yield out.filter(batch.column("_own"))

    return read


def codes_above(rows: DataFrame, items: DataFrame, anchors: DataFrame, reach: float = 250.0, left: float = 0.35) -> DataFrame:
    """(file, page, item, modelo, code): rows whose name is specifications only take the code of their block: the text of the lowest
    item with a code above them (first extracted of one height), within ``reach`` and left of that share of the mean x of the
    page's price anchors, unless the name holds its first word. code: what was taken, else null. Pages without anchors give no
    codes. One ordered pass over a page."""
    middle = _renamed(anchors.groupBy(*PAGE).agg(F.avg("x").alias("x")), "p")
    coded = F.col("text").rlike(rf"(?i){CODE}") & ~F.trim("text").rlike(rf"(?i)^({BLOCK_TITLES})\b")
    codes = items.where(coded & (F.col("x") >= 0) & F.col("y").isNotNull()).join(middle, _same_page("p")).where(F.col("x") <= F.col("p_x") * left)
    given = codes.select(*PAGE, "y", F.lit(1).alias("kind"), (-F.col("item")).alias("turn"), F.struct("y", F.trim("text").alias("text")).alias("code"))
    own = rows.select(*PAGE, "y", F.lit(0).alias("kind"), F.col("item").alias("turn"), F.lit(None).cast(given.schema["code"].dataType).alias("code"), "item", "modelo")
    down = Window.partitionBy(*PAGE).orderBy("y", "kind", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = own.unionByName(given, allowMissingColumns=True).withColumn("code", F.last("code", ignorenulls=True).over(down)).where("kind = 0")
    first = F.lower(F.element_at(F.split(F.col("code.text"), r"\s+"), 1))
    takes = spec_only(F.col("modelo")) & (F.col("y") - F.col("code.y") <= reach) & ~F.contains(F.lower("modelo"), first)
    taken = seen.withColumn("taken", F.when(takes, F.col("code.text")))
    return taken.select(*PAGE, "item", F.coalesce("taken", "modelo").alias("modelo"), F.col("taken").alias("code"))
