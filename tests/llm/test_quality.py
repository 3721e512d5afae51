import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyorder.llm import quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), [False] * len(words)
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered[i : i + 5] = [True] * 5
    lines, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, sum(covered)


TEXTS = [
    None, "", " ", "\n\n", "one", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 30, "a\na\n\n \na", "é ü # * | < >",
    "\ta b\r\nc\x0bd\x0ce f", "A a A a A a A a", "the same line here now\n" * 3, "w%d " * 5000, " ".join(map(str, range(20_000))),
]


def test_counts_equal_brute_force(spark, data):
    texts = TEXTS + [r.text for r in queries.documents(spark, data).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "'x' AS n_words", "1 AS base_failed")
    found = {r.id: tuple(r[c] for c in quality.COUNTS) for r in quality.statistics(df).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}


def test_base_rules(spark):
    rows = [(1, "w " * 9), (2, " ".join(f"w{i}" for i in range(10))), (3, "a b c d e a b c d e"), (4, None)]
    found = {r.id: r.base_failed for r in quality.statistics(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert found == {1: True, 2: False, 3: True, 4: True}


@pytest.fixture(scope="module")
def corpus(spark):
    """Words of three to eight letters; document 0 of each source is all symbols."""
    rng = np.random.default_rng(0)

    def text(junk):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(rng.integers(60, 300))]
        return " ".join(w + "###" * junk for w in words)

    rows = [(i, lang, source, text(i % 100 == 0)) for i, (lang, source) in enumerate((la, so) for la in ("x", "y", None) for so in ("s", None) for _ in range(100))]
    rows += [(1000 + i, "z", f"rare{i}", text(False)) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")


def test_outliers_of_their_group(spark, corpus):
    counts = quality.materialize(quality.statistics(corpus).drop("text"), "counts")
    found = quality.judge(counts, quality.fit(counts)).collect()
    assert len(found) == 605
    rejected = {r.doc_id for r in found if not r.kept}
    assert rejected == {0, 100, 200, 300, 400, 500}


def plain_verdicts(rows):
    """(id, lang, source, text) rows to id: kept, by one plain estimate after another."""
    out, labelled = {}, {}
    for i, lang, source, text in rows:
        c = brute(text)
        if c[0] < 10 or 100 * c[4] > 20 * c[0]:
            out[i] = False
        else:
            labelled.setdefault((lang or "", source or ""), []).append((i, c))
    rare = Counter()
    for (lang, _), docs in labelled.items():
        rare[lang] += len(docs) if len(docs) < quality.MIN_GROUP else 0
    pools = {}
    for (lang, source), docs in labelled.items():
        pool = (lang, source) if len(docs) >= quality.MIN_GROUP else (lang,) if rare[lang] >= quality.MIN_GROUP else ()
        pools.setdefault(pool, []).append(docs)
    rank = lambda values, p: np.sort(values)[max(0, int(np.ceil(p * len(values))) - 1)]
    floors = np.array(quality.FLOORS)
    for labels in pools.values():
        good = [d for docs in labels for d in docs]
        if len(good) < quality.MIN_GROUP:
            out |= {i: True for i, _ in good}
            continue
        c = np.array([c for _, c in good], float)
        typical = np.average([rank([c[1] / c[0] for _, c in docs], 0.5) for docs in labels], weights=[len(docs) for docs in labels])
        n, chars = c[:, 0] + 50, c[:, 1] + 50 * typical
        x = np.stack([np.log(chars / n), np.log1p(1000 * c[:, 2] / chars), np.log1p(100 * c[:, 3] / n), np.log1p(100 * c[:, 4] / n)], 1)
        middle = np.array([rank(v, 0.5) for v in x.T])
        spread = np.maximum([(rank(v, 0.75) - rank(v, 0.25)) / 1.349 for v in x.T], floors)
        squashed = np.tanh((x - middle) / spread)
        ridge = np.diag(floors**2)

        def distance(centre, cov):
            d = x - centre
            return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

        def moments(part, share):
            factor = share / quality._chi2(quality._chi2_quantile(share, 4), 6)
            return part.mean(0), np.cov(part.T, bias=True) * factor + ridge

        best = None
        for cov in (np.diag(spread**2), np.cov(squashed.T, bias=True) * np.outer(spread, spread)):
            now, logdet = (middle, cov + ridge), np.inf
            while True:
                d2 = distance(*now)
                step = moments(x[d2 <= rank(d2, 0.75)], 0.75)
                fell = np.linalg.slogdet(step[1])[1] / 2
                if logdet - fell <= 1e-4:
                    break
                now, logdet = step, fell
            if best is None or logdet < best[0]:
                best = logdet, now
        d2 = distance(*best[1])
        d2 = distance(*moments(x[d2 <= quality._chi2_quantile(0.975, 4)], 0.975))
        out |= {i: bool(d <= quality._chi2_quantile(1 - quality.ALPHA, 4)) for (i, _), d in zip(good, d2)}
    return out


def test_verdicts_equal_plain_estimates(spark, corpus):
    docs = corpus.filter("doc_id < 600").collect()
    counts = quality.materialize(quality.statistics(corpus.filter("doc_id < 600")).drop("text"), "counts")
    assert {r.doc_id: r.kept for r in quality.judge(counts, quality.fit(counts)).collect()} == plain_verdicts(map(tuple, docs))


def test_query_equals_plain_counts_and_estimates(spark):
    sf = "/root/testdata/sf0.01"
    docs = queries.documents(spark, sf).select("doc_id", "lang", "source", "text").collect()
    found = {r.doc_id: r for r in queries.op9_robust_outliers(spark, sf).collect()}
    assert len(found) == len(docs)
    for d in docs:
        n = brute(d.text)
        assert tuple(found[d.doc_id][c] for c in quality.COUNTS) == n
        assert found[d.doc_id].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    assert {i: r.kept for i, r in found.items()} == plain_verdicts(map(tuple, docs))
    assert 0 < sum(not r.kept and not r.base_failed for r in found.values()) < 0.1 * len(docs)


def test_names_of_its_own_are_free(spark, corpus):
    names = ["typical", "m0", "l00", "group", "_group", "lang_", "words", "lines", "row", "text", "pairs", "h1", "x0", "start", "k", "n", "d2", "old", "_n", "_words"]
    wide = corpus.withColumn("body", F.col("text")).withColumns({c: F.lit(f"own {c}") for c in names})
    counts = quality.materialize(quality.statistics(wide, "body").drop("body"), "counts")
    assert [c for c in wide.columns if c != "body"] == [c for c in counts.columns if c not in (*quality.COUNTS, "base_failed")]
    found = quality.judge(counts, quality.fit(counts)).collect()
    assert {r.doc_id for r in found if not r.kept} == {0, 100, 200, 300, 400, 500}
    assert all(r[c] == f"own {c}" for r in found for c in names)


def test_verdict_does_not_depend_on_order_of_rows(spark, corpus):
    verdicts = []
    for part in (corpus, corpus.orderBy(F.desc("doc_id")).repartition(3)):
        counts = quality.materialize(quality.statistics(part).drop("text"), "counts")
        verdicts.append({r.doc_id: r.kept for r in quality.judge(counts, quality.fit(counts)).collect()})
    assert verdicts[0] == verdicts[1]


def test_small_and_empty_tables_reject_only_by_base_rules(spark):
    rows = [(1, "en", "s", " ".join(f"w{i}" for i in range(20))), (2, None, None, None), (2, None, None, "### " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    for part, kept in ((df, [False, False, True]), (df.limit(0), [])):
        counts = quality.materialize(quality.statistics(part).drop("text"), "counts")
        assert sorted(r.kept for r in quality.judge(counts, quality.fit(counts)).collect()) == kept


def test_chi_square():
    assert abs(quality._chi2_quantile(0.975, 4) - 11.1433) < 1e-3
    assert abs(quality._chi2(5.385, 4) - 0.75) < 1e-3


def test_no_python(spark, data):
    plan = queries.op9_robust_outliers(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "MapInArrow", "Pandas"))
