"""Product names tidied word by word: colours of a colour field, kinds at a name's end, repeated words. Native expressions; null
texts are empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lonja.functions.text import model_and_variant

# Words a colour field keeps, words it gives away, kinds and states at a name's end, words that are no name alone.
KEPT_COLOURS = "black|white|pink|blue|red|green|purple|grey|gray|silver|gold|orange|brown|cyan|magenta|yellow|coffee|periwinkle|lavender|cream|obsidian|sakura|phantom|gunmetal|blackberry|neon|arctic|translucent|matte|glossy|negro|blanco|rosa|azul|rojo|verde|violeta|gris|plateado|dorado|naranja|marron|amarillo|transparent|smoke|mint|navy|beige"
MOVED_WORDS = r"wired|wireless|bluetooth|2.4g(?:hz)?|tri[\s-]?mode|usb[\s-]?c|rgb|mouse|raton|keyboard|teclado|headset|auricular|earphone|earbuds|controller|gamepad|joystick|mousepad|switch|webcam|camera|camara|numpad|chair|silla|monitor|speaker|parlante|microphone|microfono|magnetic|hall\s*effect"
KINDS = "mouse|keyboard|controller|headset|earphone|earbuds|numpad|mousepad|webcam|camera|microphone|switch|chair|desk|hub|adapter|cable|stand|gamepad|dock|receiver"
STATES = "released|new|upcoming"
NO_NAME = r"combo|wired|wireless|bluetooth|mechanical|gaming|optical|rgb|silent|magnetic|hall|usb|2\.4g|pro|ultra|max"
ROUNDS = 5


def _text(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def _firsts(words: Column, shortest: int = 0) -> Column:
    """Words without later repeats in any case; numbers and words of at most ``shortest`` characters repeat."""
    lower = F.transform(words, F.lower)
    free = lambda w: (F.length(w) <= shortest) | w.rlike(r"^[\d.,$/-]+$") if shortest else F.lit(False)
    return F.filter(words, lambda w, i: free(w) | (F.array_position(lower, F.lower(w)) == i + 1))


def colour_field(text: Column) -> Column:
    """Struct of color (the colour words of a colour field, each once) and moved (its words of connections and kinds, in order of
    the text); all else is dropped."""
    t, gone = _text(text), rf"(?i)\b(?:{MOVED_WORDS})\b"
    kept = F.regexp_extract_all(F.regexp_replace(t, gone, " "), F.lit(rf"(?i)\b({KEPT_COLOURS})\b"), 0)
    return F.struct(F.array_join(_firsts(kept), " ").alias("color"), F.regexp_extract_all(t, F.lit(gone), 0).alias("moved"))


def trailing_kind(model: Column, variant: Column) -> Column:
    """Struct of modelo and variante: a kind or state at the end of a name goes to the end of the variant, "combo" at its start to the
    beginning, until the name stays, ROUNDS times at most; a lone word that is no name keeps its kind."""
    words = F.split(_text(model), r"\s+")
    start = F.struct(words.alias("words"), _text(variant).alias("v"), F.lit(0).alias("moved"))

    def step(s: Column, _: Column) -> Column:
        w, n = s["words"], F.size(s["words"])
        last, first = F.element_at(w, -1), F.element_at(w, 1)
        tail = last.rlike(rf"(?i)\b({KINDS})$") | last.rlike(f"(?i)^({STATES})$")
        ends = (n >= 2) & tail & ~((n == 2) & first.rlike(f"(?i)^({NO_NAME})$"))
        begins = (n >= 2) & ~tail & (F.lower(first) == "combo")
        tidy = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
        return F.struct(
            F.when(ends, F.slice(w, 1, F.greatest(n - 1, F.lit(1)))).when(begins, F.slice(w, 2, n)).otherwise(w).alias("words"),
            F.when(ends, tidy(F.concat_ws(" ", s["v"], last))).when(begins, tidy(F.concat_ws(" ", first, s["v"]))).otherwise(s["v"]).alias("v"),
            (s["moved"] + (ends | begins).cast("int")).alias("moved"),
        )

    end = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step)
    return F.struct(F.when(end["moved"] > 0, F.array_join(end["words"], " ")).otherwise(_text(model)).alias("modelo"), end["v"].alias("variante"))


def title(text: Column, brand: Column) -> Column:
    """Struct of modelo and variante of a title: its brand is taken off the front, words do not repeat (numbers and words of two
    characters may), the first brackets hold the variant."""
    known = F.coalesce(brand != "OTRO", F.lit(False)) & (brand != "")
    front = F.concat(F.lit(r"(?i)^\Q"), F.coalesce(brand, F.lit("")), F.lit(r"\E"))
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    bare = F.when(known, F.trim(F.regexp_replace(t, F.concat(front, F.lit(r"\s+")), F.lit("")))).otherwise(t)
    once = F.array_join(_firsts(F.split(bare, " "), 2), " ")
    return model_and_variant(F.when(known, F.regexp_replace(once, F.concat(front, F.lit(r"\s*")), F.lit(""))).otherwise(once))
