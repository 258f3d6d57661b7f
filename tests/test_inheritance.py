"""Names inherited down pages and files against plain loops, with nulls, ties, small blocks and no rows."""

import random
import re

from lonja.operators import inheritance as op

ROWS = "file string, page long, item long, y double, x double, modelo string, variante string, fob double, note string"


def _bare(raw):
    words = [w for w in re.split(r"[\s\-+/]+", raw.lower()) if w]
    spec = words and not re.search(r"(^|[\s-])(?!paw\d)[a-z]{1,6}\d{1,4}", raw, re.I) and (re.fullmatch(r"paw\d\w*", "".join(words)) or all(re.fullmatch(op.SPEC, w) for w in words))
    return not raw or raw.startswith("(") or bool(spec) or bool(re.fullmatch(op.COLOURS, raw, re.I))


def _page(rows):
    """Rows of a page one after the other: names that hold, swaps corrected from below, merged cells."""
    rows = sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[4] is not None, r[4] or 0, r[2]))
    holds, price, out = "", None, []
    for _, _, item, y, _, modelo, variante, fob, _ in rows:
        raw, v = (modelo or "").strip(" "), (variante or "").strip(" ")
        name = "" if raw.startswith("(") else raw
        good, sets = holds and not re.search(rf"\b({op.LOUD})\b", holds, re.I), True
        if _bare(raw) and good:
            kind, model = "inherited", holds
        elif _bare(raw) and v:
            kind, model, sets = "swap", v, False
        elif name:
            kind, model, sets = "own", name, len(name) > 2 and name.lower() not in ("item", "producto")
        else:
            continue
        used = model.lower().split()
        out.append({"item": item, "y": y, "fob": fob, "kind": kind, "model": model, "from": price if kind == "inherited" else None, "blank": not raw, "v": v, "wait": kind == "swap" and not raw, "filled": None, "fused": None})
        if out[-1]["wait"]:
            out[-1]["v"] = " ".join(w for w in v.split() if w.lower() not in used)
        elif raw and kind != "swap":
            for p in reversed(out[:-1]):
                if not p["wait"]:
                    break
                p["filled"] = p["model"] = model
                p["wait"] = False
        if sets:
            holds, price = model, fob
    ys = sorted({r[3] for r in rows if r[3] is not None})
    gaps = [b - a for a, b in zip(ys, ys[1:]) if 5 < b - a < 300]
    height = int(sum(gaps) / len(gaps) * 100 + 0.5) / 100 if gaps else op.HEIGHT
    for i, r in enumerate(out):
        if r["kind"] != "inherited" or r["fob"] is None or r["from"] is None or abs(r["fob"] - r["from"]) < op.CENT or r["y"] is None:
            continue
        for c in out[i + 1 :]:
            if c["kind"] != "inherited" and c["fob"] is not None and abs(c["fob"] - r["fob"]) <= op.CENT:
                if c["y"] - r["y"] <= height * op.REACH and c["model"] and c["model"] != r["model"]:
                    r["fused"] = r["model"] = c["model"]
                break
    return {r["item"]: (r["kind"], r["model"], r["v"], r["filled"], r["fused"]) for r in out}


def test_names_down_a_page(spark):
    from lonja.operators.spatial import row_heights

    r = random.Random(4)
    names = ["", "", None, "black", "K70 Pro", "M750", "V8", "new items ceased", "(note", "wired mode", "PAW3395", "item", " "]
    rows = [(f, p, 1000 * k + i, r.choice([None, *range(0, 200, 20)]) if r.random() < 0.2 else i // 3 * 20.0, float(r.choice([0, 50])), r.choice(names), r.choice(["", None, "red", "M750 blue"]), r.choice([1.0, 1.01, 2.5, None]), "x") for k, (f, p) in enumerate((f, p) for f in ("a", None) for p in (1, 2, 3, None)) for i in range(40)]
    rows = [(f, p, i, None if y is None else float(y), *rest) for f, p, i, y, *rest in rows]
    df = spark.createDataFrame(rows, ROWS)
    got = op.fused(op.filled(op.carried(df)), row_heights(df))
    want = {}
    for f, p in {(x[0], x[1]) for x in rows}:
        want |= _page([x for x in rows if (x[0], x[1]) == (f, p)])
    assert {x["item"]: (x["kind"], x["modelo"], x["variante"], x["filled"], x["fused"]) for x in got.collect()} == want
    kinds = [w[0] for w in want.values()]
    assert min(kinds.count(k) for k in ("own", "inherited", "swap")) > 5 and any(w[3] for w in want.values()) and any(w[4] for w in want.values())
    none = df.limit(0)
    assert op.fused(op.filled(op.carried(none)), row_heights(none)).isEmpty()


def _core(name):
    return " ".join(re.sub(rf"(?i)\b({op.FAMILY_COLOURS})\b", "", name).split())


def _alone(name):
    return re.fullmatch(rf"(?i)({op.FAMILY_ALONE})[\s\-.]*", name.strip())


def test_families_in_blocks(spark, monkeypatch):
    """Blocks of four rows, one brand with most of them; runs of colours longer than many blocks."""
    monkeypatch.setattr(op, "BLOCK", 4)
    r = random.Random(8)
    names = ["Viper Ultimate Cyberpunk Red", "Black", "white", "dark blue", "Pink -", "Ornata V3 X low profile", "K1", "Green Black Quartz 12", None, "", "clear -----------------", "X" * 5000, "Red Black Q123456789"]
    rows = [("f" if i % 9 else None, i // 50, i, float(i // 2 % 7), 0.0, "white" if 200 < i < 260 else r.choice(names), r.choice(["", None, "3-Mode"]), None if i % 11 == 0 else "AULA" if i % 3 else "KZ") for i in range(400)]
    df = spark.createDataFrame(rows, "file string, page long, item long, y double, x double, modelo string, variante string, marca string").selectExpr("*", "'c' AS cat", "1 AS base", "2 AS _rank")
    past, want = {}, {}
    for f, page, item, y, x, modelo, variante, marca in sorted(rows, key=lambda t: (t[1], t[3], t[4], t[2])):
        model, variant, base = modelo or "", variante or "", None
        short = model.strip()
        before = past.setdefault((f, marca), [])
        if len(short) <= op.SHORT and (_alone(short) or re.fullmatch(r"(?i)[a-z\s-]+", short)):
            long = [p for p in before[-3:] if len(p) > op.BASE and not _alone(p)]
            if long and len(_core(long[-1])) > op.CORE:
                base = _core(long[-1])
                model, variant = base, f"{short} {variant}".strip()
        before.append(model)
        want[item] = (model, variant, base)
    assert {t["item"]: (t["modelo"], t["variante"], t["base"]) for t in op.families(df).collect()} == want
    assert sum(w[2] is not None for w in want.values()) > 40
    assert op.families(df.limit(0)).isEmpty()


def test_lines_above_a_price(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 10)
    r = random.Random(3)
    texts = ["AJ139 Pro", "Red $12.50 -", "USD", "机械键盘", "6941234567890", "¥85", "damulin x", "F75  keyboard", None, "", "$3.20", "¥9 $14 blue", "z" * 130, "w" * 119, "Wired"]
    rows = [("f" if i % 60 else None, i // 35, float(i // 2), i, r.choice(texts)) for i in range(300)]
    got = op.row_context(spark.createDataFrame(rows, "file string, page long, y double, item long, text string"))

    def noise(t):
        return not 2 <= len(t) <= op.LONGEST_LINE or any(re.search(p, t) for p in op.NOISE)

    want = {}
    for f in ("f", None):
        lines = [(x[3], x[4] or "") for x in sorted(rows, key=lambda x: (x[1], x[2], x[3])) if x[0] == f]
        price = [bool(re.search(r"(?<![¥￥\d])\$\s*\d", t)) for _, t in lines]
        for i, (item, text) in enumerate(lines):
            if not price[i]:
                continue
            kept = []
            for j in range(i - 1, max(-1, i - 9), -1):
                if price[j] or len(kept) == 5:
                    break
                kept = kept if noise(lines[j][1]) else [lines[j][1], *kept]
            bare = re.sub(r"(?<![¥￥])\$\s*[\d,]+\.?\d*", "", re.sub(r"[¥￥]\s*[\d,]+\.?\d*", "", text)).strip()
            inline = "" if noise(bare) else re.sub(r"[-\s]+$", "", bare)
            model = (kept[0] if kept else inline)[:80].strip()
            if model:
                want[item] = (model, " ".join(" ".join([*kept[1:], inline]).split())[:80] if kept else "")
    assert {x["item"]: (x["modelo"], x["variante"]) for x in got.collect()} == want and len(want) > 30
