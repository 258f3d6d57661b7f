"""Column functions on product texts: prices, brands, categories and the quality of a model name. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lonja.functions import vocabulary as v


def usd_price(line: Column) -> Column:
    """The first dollar price of a line that follows no yen sign or digit; null outside 0.10 to 500."""
    found = F.regexp_extract(line, r"(?<![¥￥\d])\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)", 1)
    price = F.when(found != "", F.replace(found, F.lit(","), F.lit("")).cast("double"))
    return F.when(price.between(0.10, 500), price)


def price_token(text: Column) -> Column:
    """A text that is a price and nothing else, with or without a currency sign; else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    clean = F.regexp_replace(t, r"[$€£¥\s]", "")
    number = F.regexp_replace(F.regexp_replace(clean, r"(\d)[.,](\d{3})(?=\D|$)", "$1$2"), "^([^,]*),", "$1.")
    good = t.rlike(r"^[$€£¥]?\s?[\d.,]+$") & clean.rlike(r"^\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?$")
    return F.when(good, number.try_cast("double"))


def brand_of_line(text: Column, custom: list[tuple[str, str]] | None = None) -> Column:
    """Brand by the caller's patterns, then by the fixed ones, in order; null if none fits."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(t.rlike(("(?i)" if own else "") + p), name) for own, rules in ((True, custom or []), (False, v.BRAND_PATTERNS)) for name, p in rules))


def brand_of_content(text: Column, custom: list[tuple[str, str]] | None = None, chars: int = 3000) -> Column:
    """Brand from the beginning of a file's text, where brand marks stand."""
    return brand_of_line(F.substring(text, 1, chars), custom)


def brand_of_file(name: Column, custom: list[tuple[str, str]] | None = None) -> Column:
    t = F.lower(name)
    own = [F.when(t.rlike("(?i)" + p), brand) for brand, p in custom or []]
    fixed = []
    for brand, words in v.BRAND_FILES:
        held = F.lit(True)
        for w in words:
            held = held & t.contains(w)
        fixed.append(F.when(held, brand))
    return F.coalesce(*own, *fixed, F.lit("OTRO"))


def category(text: Column, brand: Column) -> Column:
    """Struct of category, confidence, source and matched text: brands of one category, then ordered words (short ones
    that mean little count less), then the brand's usual category, else OTRO."""
    t = F.lower(F.coalesce(text, F.lit("")))

    def found(cat: Column, confidence, source: str, matched: Column) -> Column:
        return F.struct(cat.alias("category"), F.lit(confidence).alias("confidence") if isinstance(confidence, int) else confidence.alias("confidence"), (F.lit(source) if isinstance(source, str) else source).alias("source"), matched.alias("matched"))

    def of(table: dict[str, str]) -> Column:
        return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[brand]

    tiers = []
    for cat, words, confidence in v.CATEGORY_PATTERNS:
        matched = F.regexp_extract(t, rf"\b({words})\b", 0)
        weak = F.trim(matched).isin(v.AMBIGUOUS_TOKENS)
        tiers.append(F.when(matched != "", found(F.lit(cat), F.when(weak, min(confidence, v.AMBIGUOUS_CONFIDENCE)).otherwise(confidence), F.when(weak, "text-keyword-ambiguous").otherwise("text-keyword"), matched)))
    only, usual = of(v.SINGLE_BRAND), of(v.BRAND_FALLBACK)
    return F.coalesce(F.when(only.isNotNull(), found(only, 95, "brand-exclusive", brand)), *tiers, F.when(usual.isNotNull(), found(usual, 50, "brand-fallback", brand)), found(F.lit("OTRO"), 0, "no-match", F.lit("")))


def price_category(cat: Column, fob: Column) -> Column:
    """Category after the price gates: a switch over 12 is a keyboard, a keyboard under 1 a switch, earphones under 1 an
    accessory."""
    first = F.when((cat == "SWITCH") & (fob > 12), "TECLADO").otherwise(cat)
    second = F.when((first == "TECLADO") & (fob > 0) & (fob < 1), "SWITCH").otherwise(first)
    return F.when((second == "AURICULAR") & (fob > 0) & (fob < 1), "ACCESORIO").otherwise(second)


def model_and_variant(text: Column) -> Column:
    """Struct of model and variant: the variant is what stands in the first parentheses."""
    t = F.trim(F.coalesce(text, F.lit("")))
    inside = F.regexp_extract(t, r"\(([^)]+)\)", 1)
    before, after = F.regexp_extract(t, r"^(.*?)\([^)]+\)(.*)$", 1), F.regexp_extract(t, r"^(.*?)\([^)]+\)(.*)$", 2)
    return F.struct(F.when(inside != "", F.trim(F.concat(before, after))).otherwise(t).alias("modelo"), F.trim(inside).alias("variante"))


def switch_token(model: Column) -> Column:
    """The word switch with up to two words before it, else magnetic, hall effect or an axis word; else null."""
    m = F.trim(F.coalesce(model, F.lit("")))
    word, hall, axis = (F.regexp_extract(m, p, 0) for p in (r"(?i)\bswitch(?:es)?\b", r"(?i)\bhall\s*effect\b", r"(?i)\b[\w.-]*axis(?:es)?\b"))
    before = F.filter(F.split(F.trim(F.regexp_extract(m, r"(?is)^(.*?)\bswitch(?:es)?\b", 1)), r"\s+"), lambda w: w != "")
    last = F.slice(before, F.greatest(F.lit(1), F.size(before) - 1), 2)
    return F.when(word != "", F.array_join(F.concat(last, F.array(word)), " ")).when(m.rlike(r"(?i)\bmagnetic\b"), "Magnetic").when(hall != "", hall).when(axis != "", axis)


def product_noun(model: Column) -> Column:
    found = F.regexp_extract(F.coalesce(model, F.lit("")), rf"(?i)\b(?:{v.NOUNS})\b", 0)
    return F.when(found != "", found)


def has_code(model: Column) -> Column:
    return model.rlike("(?i)" + v.CODE)


def marketing_class(model: Column, cat: Column) -> Column:
    """switch-axis, code, noun-phrase, puffery, marketing-only or plain."""
    m, c = F.trim(F.coalesce(model, F.lit(""))), F.lower(F.trim(F.coalesce(cat, F.lit(""))))
    token, noun = F.when(~c.isin("switch", "interruptor"), switch_token(m)), product_noun(m)
    n = F.regexp_count(m, F.lit(rf"(?i)\b(?:{v.MARKETING})\b"))
    return F.when(m == "", "plain").when(token.isNotNull() & noun.isNull(), "switch-axis").when(has_code(m), "code").when(noun.isNotNull() & (n <= 1) & (F.lower(noun) != F.lower(F.coalesce(cat, F.lit("")))), "noun-phrase").when((n >= 2) & noun.isNull(), "puffery").when(n >= 1, "marketing-only").otherwise("plain")


def model_quality(model: Column, cat: Column, raw: Column) -> Column:
    """Struct of level (GREEN, YELLOW, RED) and reasons of a model name; raw is the row's source text."""
    m, c, r = F.trim(F.coalesce(model, F.lit(""))), F.trim(F.coalesce(cat, F.lit(""))), F.coalesce(raw, F.lit(""))
    digit, code = m.rlike(r"\d"), has_code(m)
    n, kind = F.regexp_count(m, F.lit(rf"(?i)\b(?:{v.MARKETING})\b")), marketing_class(m, c)
    heavy = ~kind.isin("noun-phrase", "switch-axis") & ((n >= 2) | (~code & ~digit & (n >= 1)))
    why = v.REASONS
    yellow = F.array_compact(
        F.array(
            F.when(~F.lower(c).isin("switch", "interruptor") & (m.rlike(r"(?i)\baxis\b|\bswitch\b") | (m.rlike(r"(?i)\bhall\s*effect\b") & ~m.rlike(r"(?i)^hall\s*effect$"))), why["switch"]),
            F.when(m.rlike(r"[({\[]") & ~m.rlike(r"[)}\]]"), why["truncated"]),
            F.when(~digit & (r.rlike(r"\b\d{12,}\b") | r.rlike(r"\b[A-Z]{1,4}\d{2,}")), why["lost_code"]),
            F.when(~code & m.rlike("(?i)" + v.GENERIC), why["generic"]),
            F.when(heavy, why["marketing"]),
            F.when(code & m.rlike("(?i)" + v.CONNECTIONS) & m.rlike(r"(?i)\bmouse\b"), why["connection"]),
            F.when(~code & m.rlike(r'(?i)\b(keycaps|backpack)\b|\d+(\.\d+)?\s*("|inch|pulg)|\bpowder\b|^\d+\s*Keys\b'), why["fragment"]),
        )
    )
    red = F.when(m == "", F.array(F.lit(why["empty"]))).when(m.rlike(r"(?i)^total\b") | m.rlike("(?i)" + v.SPECS), F.array(F.lit(why["specs"])))
    return F.struct(F.when(red.isNotNull(), "RED").when(F.size(yellow) > 0, "YELLOW").otherwise("GREEN").alias("level"), F.coalesce(red, yellow).alias("reasons"))


def model_classes(model: Column) -> Column:
    """Struct of booleans: template, bare, ambiguous, watch, truncated, bare type word, type word inside."""
    m = F.trim(F.coalesce(model, F.lit("")))
    one = F.trim(F.regexp_replace(F.regexp_replace(F.lower(m), r"[^a-z\s]", " "), r"\s+", " "))
    single, head = (one != "") & ~one.contains(" "), F.regexp_extract(m, r"(?s)^(.*)\s\S+$", 1)
    opened, closed = (F.regexp_count(m, F.lit(p)) for p in (r"\(", r"\)"))
    return F.struct(
        m.rlike("(?i)" + v.TEMPLATES).alias("template"), (single & one.isin(v.BARE_WORDS)).alias("bare"), (single & one.isin(v.AMBIGUOUS_WORDS)).alias("ambiguous"), (single & one.isin(v.WATCH_WORDS)).alias("watch"),
        (opened > closed).alias("truncated"), (single & one.rlike(v.TYPE_WORDS)).alias("bare_type"), head.rlike("(?i)" + v.TYPE_WORDS).alias("type_inside"),
    )


def expanded(text: Column) -> Column:
    """Lower case with English words replaced one after the other; a replacement may be replaced again."""
    t = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    for word, spanish in v.SYNONYMS.items():
        t = F.regexp_replace(t, rf"\b{word}\b", f" {spanish} ")
    return t


def colour_name(r: Column, g: Column, b: Column) -> Column:
    """Colour family of a pixel."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    saturation, light = F.when(most > 0, (most - least) / most).otherwise(0.0), most / 255
    return (
        F.when(light < 0.22, "BLACK").when((saturation < 0.12) & (light > 0.85), "WHITE").when(saturation < 0.12, F.when(light > 0.55, "SILVER").otherwise("GRAY"))
        .when((r > g + 40) & (r > b + 40), F.when((g > 100) & (b < 80), "GOLD").when(g < 80, "RED").otherwise("ORANGE"))
        .when((g > r + 25) & (g > b + 25), "GREEN")
        .when((b > r + 30) & (b > g + 15), F.when((r > 80) & (g < 100), "PURPLE").when(g > 150, "CYAN").otherwise("BLUE"))
        .when((r > 140) & (g < 130) & (b > 120), "PINK").when((r > 120) & (g > 100) & (b < 80), "GOLD").otherwise("MULTICOLOR")
    )


def image_state(img: Column) -> Column:
    """valid (a data url of an image), loose (begins like one) or none."""
    strict = F.trim(img).rlike(r"(?i)^data:image/(?:png|jpe?g|webp|gif);(?:base64,[a-z0-9+/=\s]+|[^\s]+)$")
    return F.when(F.coalesce(strict, F.lit(False)), "valid").when(F.coalesce(F.lower(F.trim(img)).startswith("data:image/"), F.lit(False)), "loose").otherwise("none")
