"""Quality verdicts and the pipeline's rows, worked out again in plain Python."""

import hashlib
import math
import random

import pytest
import sentencepiece

import corpus_pipeline
from arborspark.llm import langid, quality, queries
from arborspark.llm.queries import MODEL

from ..conftest import SF_DIR
from .test_results import classes_of


def votes(m):
    n, lines = max(m["n_words"], 1), max(m["n_lines"], 1)
    length, symbols, repeats, dup, upper, variety = m["word_chars"] / n, m["n_symbols"] / n, m["n_repeat_words"] / n, m["n_dup_lines"] / lines, m["n_upper"] / n, m["n_distinct"] / math.sqrt(n)
    each = [
        (3 <= length <= 9, length < 2 or length > 14), (symbols <= 0.02, symbols > 0.1), (m["n_dup_lines"] == 0, dup > 0.5), (repeats <= 0.05, repeats > 0.3),
        (upper <= 0.15, upper > 0.5), (variety >= 2, m["n_words"] >= 30 and variety < 1.3),
    ]
    return [-1 if bad else int(good) for good, bad in each]


def posteriors(docs, smooth=1.0, slip=0.01, anchor=0.5):
    """Expectation-maximisation a document at a time. Class 0 is good, class 1 + j is bad in
    the way that rule j sees; votes are independent within a class, abstentions say nothing."""
    rules, classes = range(len(docs[0])), range(1 + len(docs[0]))
    side = lambda v: 0 if v == -1 else 1

    def shares(resp):
        out = []
        for c in classes:
            own = []
            for r in rules:
                overall = [smooth + sum(d[r] == v for d in docs) for v in (-1, 1)]
                seen = [sum(p[c] for p, d in zip(resp, docs, strict=True) if d[r] == v) + smooth * o / sum(overall) for v, o in zip((-1, 1), overall, strict=True)]
                own.append([x / sum(seen) for x in seen])
            out.append(own)
        return out

    resp = [[float(-1 not in d), *[float(v == -1) for v in d]] for d in docs]
    lik = shares(resp)
    lik[0] = [[(1 - slip) * a + slip, (1 - slip) * b] for a, b in lik[0]]
    weight = [sum(p[c] for p in resp) + smooth for c in classes]
    weight = [w / sum(weight) for w in weight]
    old = [[0.0] * len(classes)] * len(docs)
    for _ in range(200):
        resp = []
        for d in docs:
            logs = [math.log(weight[c]) + sum(math.log(max(lik[c][r][side(d[r])], 1e-300)) for r in rules if d[r]) for c in classes]
            p = [math.exp(x - max(logs)) for x in logs]
            resp.append([x / sum(p) for x in p])
        done = max(abs(a - b) for p, q in zip(resp, old, strict=True) for a, b in zip(p, q, strict=True)) < 1e-9
        old, lik = resp, shares(resp)
        for j in rules:
            if lik[1 + j][j][0] < anchor:
                lik[1 + j][j] = [anchor, 1 - anchor]
        weight = [sum(p[c] for p in resp) + 1e-6 for c in classes]
        weight = [w / sum(weight) for w in weight]
        if done:
            break
    return [p[0] for p in resp]


def check_verdicts(rows):
    want = posteriors([votes(r) for r in rows])
    for r, p in zip(rows, want, strict=True):
        assert r["quality"] == pytest.approx(p, abs=1e-6)
        if abs(p - 0.5) > 1e-6:
            assert r["kept"] == (p >= 0.5 and r["n_words"] >= 20 and 100 * r["n_repeat_words"] <= 30 * r["n_words"])


def test_op2_verdicts(spark):
    full = quality.judge(spark.read.parquet(f"{SF_DIR}/documents.parquet"), keep=["doc_id"]).collect()
    check_verdicts(full)
    assert {r["doc_id"]: (r["kept"], r["quality"]) for r in full} == {r["doc_id"]: (r["kept"], r["quality"]) for r in queries.op2_quality_rules(spark, SF_DIR).collect()}


@pytest.mark.parametrize("texts", [["plain words of one kind only " * 6] * 5, ["# $ % & " * 30] * 4, ["good text with some different words in every place of it " + "abc " * i for i in range(20, 26)] + ["XX " * 40] * 3])
def test_op2_verdicts_of_few_patterns(spark, texts):
    check_verdicts(quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


VOCABULARY = {"en": "the house and with from garden window yellow river morning", "de": "der haus und mit aus garten fenster gelbe fluss morgen", "fr": "la maison et avec depuis jardin fenetre jaune riviere matin"}


def fixture():
    rng = random.Random(11)
    rows, shared = [], "a notice that many of these documents share"
    for i in range(36):
        lang = rng.choice(list(VOCABULARY))
        lines = [" ".join(rng.choices(VOCABULARY[lang].split(), k=rng.randrange(6, 14))) + f" {rng.randrange(10**9)}" for _ in range(rng.randrange(2, 6))]
        if i % 5 == 0:
            lines.insert(1, shared if i % 10 else shared.replace("many", "mady"))
        if i % 7 == 0:
            lines += ["", lines[0]]
        rows.append((i, "\n".join(lines), lang, rng.choice(["s1", "s2", "s2", "s2", None])))
    for i in (3, 8):  # near copies: one long line, two of its words changed
        words = [rng.choice(VOCABULARY["en"].split()) + str(rng.randrange(999)) for _ in range(90)]
        rows.append((40 + i, " ".join(words), "en", "s1"))
        words[70], words[89] = "changed", "again"
        rows.append((50 + i, " ".join(words), "en", "s2"))
    rows += [(70, None, "en", "s1"), (71, "", None, "s1"), (72, "123 456", "de", "s3"), (73, rows[2][1], "en", "s3")]
    return [(*r, len(r[1] or "")) for r in rows]


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def language_cost(sample):
    counts = {x: {} for x in sample}
    for x, texts in sample.items():
        for t in map(str.encode, texts):
            for k in range(langid.ORDER + 1):
                for i in range(k, len(t)):
                    seen = counts[x].setdefault(t[i - k : i], {})
                    seen[t[i]] = seen.get(t[i], 0) + 1

    def bits(x, t):
        out = 0.0
        for i in range(len(t)):
            for k in range(min(i, langid.ORDER), -1, -1):
                seen = counts[x].get(t[i - k : i])
                if seen:
                    whole = sum(seen.values()) + len(seen)
                    if t[i] in seen:
                        out += math.log2(whole / seen[t[i]])
                        break
                    out += math.log2(whole / len(seen))
            else:
                out += 8
        return out

    return bits


def brute(spark, rows):
    """The pipeline's (doc_id, text, times)."""
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sample = langid.sample(d, "text", "lang", "doc_id", 256)
    bits = language_cost(sample)
    docs = [(i, t, s) for i, t, _, s, _ in rows if t and any(c.isalpha() for c in t) and min(bits(x, t.encode()) for x in sample) <= 8 * len(t.encode())]
    # lines, judged on the input
    seen, left = [], []
    for i, t, s in sorted(docs):
        keep = []
        for line in t.split("\n"):
            near = [x for x in seen if x == line or (len(x) >= 20 and len(line) >= 20 and one_edit(x, line))] if any(c.isalnum() for c in line) else []
            seen.append(line)
            if not near:
                keep.append(line)
        if len(keep) == len(t.split("\n")) or "\n".join(keep).strip(" "):
            left.append((i, "\n".join(keep), s))
    first, _ = classes_of([(i, t) for i, t, _ in left])
    docs = [x for k, x in enumerate(left) if k in first]
    # mixing
    words = lambda t: len([w for w in t.replace("\n", " ").split(" ") if w])
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, free = {s: 1 + k % 3 for k, s in enumerate(order)}, {}, set(order)
    while True:
        rest = sum(size.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    out = []
    for s in order:
        whole = int(target[s] // size[s])
        wanted, upto = target[s] - whole * size[s], 0
        key = lambda x: hashlib.md5(f"42:{x[0]}:{hashlib.md5(x[1].encode()).hexdigest()}".encode()).hexdigest()
        for x in sorted((x for x in docs if x[2] == s), key=key):
            n = words(x[1])
            extra = wanted > 0 and whole < 3 and 2 * upto + n <= 2 * wanted
            upto += n
            out += [(x[0], x[1])] * (whole + extra)
    return sorted(out)


def test_pipeline_rows(spark, tmp_path):
    rows = fixture()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(spark, rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in want]
    sp, text = sentencepiece.SentencePieceProcessor(model_file=MODEL), dict(want)
    assert all(r["ids"] == sp.encode(text[r["doc_id"]]) and r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in got)
    # near copies, texts without a letter and the exact copy go
    assert not {53, 58, 70, 71, 72, 73} & {i for i, _ in want} and len({i for i, _ in want}) > 20
