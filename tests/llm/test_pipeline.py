"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lonja.llm import mixing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string"


def _rows():
    r = random.Random(12)
    out = []
    for i in range(260):
        w = [r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randrange(5000)) for _ in range(r.choice([60, 90, 150]))]
        if i % 6 == 0:
            w[r.randrange(len(w))] = r.choice(["idiot", "morons"])
        out.append((i, " ".join(w), ["en", "de"][i % 2], ["a", "b", None][i % 3], 0, "clash"))
    out += [(300 + i, out[i][1] + " more", *out[i][2:]) for i in range(1, 20)]  # near copies
    out += [(330, out[7][1], *out[7][2:]), out[8], (8, out[9][1][::-1], "en", "a", 0, "other text, same id")]
    out += [(340, "# | * " * 40 + out[2][1], "en", "a", 0, ""), (341, "same old words " * 40, "de", "b", 0, ""), (342, "short", "de", "b", 0, ""), (343, None, None, None, None, None), (344, "", "en", "a", 0, "")]
    return out


def _features(text):
    w, lines = WORD.findall(text or ""), [y for y in (text or "").split("\n") if WORD.search(y)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = collections.Counter(windows)
    covered = {k + d for k, g in enumerate(windows) if often[g] > 1 for d in range(3)}
    n = max(1, len(w))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "") / n
    return failed, symbols, (len(lines) - len(set(lines))) / max(1, len(lines)), len(covered) / n, sum(map(len, w)) / n


def _kept(rows):
    """Verdicts by thresholds recomputed from exact quantiles (the least value with that share of the values up to it)."""
    seen = [_features(x["text"]) for x in rows]

    def at(values, rank):
        v = sorted(values)
        return v[max(0, math.ceil(rank * len(v)) - 1)]

    def limits(members, least, of):
        """of() over the rows of the group, of its language, or of all, whichever first has enough."""
        found = {}
        for k in members:
            lang, source = rows[k]["lang"], rows[k]["source"]
            for part in ([j for j in members if (rows[j]["lang"], rows[j]["source"]) == (lang, source)], [j for j in members if rows[j]["lang"] == lang], members):
                if len(part) >= least or part is members:
                    found[lang, source] = of([seen[j] for j in part])
                    break
        return found

    def up(x):
        return math.ceil(x * 100) / 100

    def tails(part):
        def beyond(k, rank):
            v = [x[k] for x in part]
            return at(v, rank) + (at(v, rank) - at(v, 0.5))

        return max(0.05, up(beyond(2, 0.99))), max(0.05, up(beyond(3, 0.99))), math.floor(beyond(4, 0.01) * 100) / 100, up(beyond(4, 0.99))

    good = [k for k in range(len(rows)) if not seen[k][0]]
    symbols = limits(good, 50, lambda part: max(0.05, up(at([x[1] for x in part], 0.5) + 4 * (at([x[1] for x in part], 0.75) - at([x[1] for x in part], 0.25)))))
    core = [k for k in good if seen[k][1] <= symbols[rows[k]["lang"], rows[k]["source"]]]
    rest = limits(core, 100, tails)
    out = []
    for k in good:
        group = rows[k]["lang"], rows[k]["source"]
        _, s, lines, repeats, length = seen[k]
        dup, rep, low, high = rest.get(group, (9, 9, 0, math.inf))
        if s <= symbols[group] and lines <= dup and repeats <= rep and low <= length <= high:
            out.append(rows[k])
    return out


def _heads(rows):
    sets = []
    for x in rows:
        w = (x["text"] or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    least = [x["doc_id"] for x in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {(x["doc_id"], x["text"]) for k, x in enumerate(rows) if x["doc_id"] == least[k]}


def test_stages_against_plain_python(spark, tmp_path):
    rows = _rows()
    docs = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(i, int(i % 6 == 0), "clash") for i in range(260)], "doc_id long, toxic int, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, given):
        out = stages[name](spark, given, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path)

    def plain(df):
        return collections.Counter(map(tuple, df.collect()))

    clean = stage("toxicity", docs)
    model = toxicity.train(docs, labels)
    wanted = model["weights"] != 0
    score = {t: 1 / (1 + math.exp(-(sum(float(w) for w in model["weights"][toxicity._present(t, wanted)]) + model["bias"]))) for t in {x[1] for x in rows}}
    assert clean.columns == docs.columns and plain(clean) == collections.Counter(x for x in rows if score[x[1]] < toxicity.THRESHOLD)
    assert not [x for x in clean.collect() if x["doc_id"] < 260 and x["doc_id"] % 6 == 0] and len(clean.collect()) > 200

    good = stage("quality rules", clean)
    assert good.columns == docs.columns and plain(good) == collections.Counter(map(tuple, _kept(clean.collect())))
    ids = {x["doc_id"] for x in good.collect()}
    assert not ids & {340, 341, 342, 343, 344} and len(ids) > 200

    unique = stage("n-gram Jaccard join", good)
    found = [(x["doc_id"], x["text"]) for x in unique.collect()]
    assert unique.columns == docs.columns and set(found) == _heads(good.collect()) and len(found) == len(set(found))
    assert sum(d == 8 for d, _ in found) == 2 and not {d for d, _ in found} & {*range(301, 306), 330}

    mixed = stage("mixing sources to target weights", unique)
    tables = mixing.mix(unique)
    block_use = collections.Counter((x["source_key"], x["block"]) for x in tables["slots"].collect())
    assert set(block_use.values()) <= {1, 2} and mixed.columns == docs.columns
    taken = collections.Counter()
    originals = dict(((d, k), t) for k, (d, t) in enumerate(found))
    for x in mixed.collect():
        taken[x["doc_id"]] += len(WORD.findall(x["text"]))
        assert any(d == x["doc_id"] and all(part in t for part in x["text"].split("\n")) for (d, _), t in originals.items())
    pieces = collections.Counter()
    for x in tables["pieces"].collect():
        pieces[x["doc_id"]] += x["length"] * x["times"]
    assert taken == pieces and all(taken[d] <= 2 * sum(len(WORD.findall(t)) for (e, _), t in originals.items() if e == d) for d in taken)

    from hashlib import sha256

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = stages["BPE encoding and decoding"](spark, mixed, str(tmp_path))
    expected = collections.Counter()
    for x in mixed.collect():
        ids = t.encode(x["text"], add_special_tokens=False).ids
        expected[x["doc_id"], len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert plain(coded) == expected
    assert plain(corpus_pipeline.run(spark, str(tmp_path))) == expected


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).select(F.count("*")).first()[0] == 0, name
