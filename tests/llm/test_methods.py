"""The methods behind secret scans, personal data, LM scores and mixing, against brute force."""

import collections
import math
import re

import numpy as np
import pytest

from graphquarry.llm import lm_score, mixing, pii, quality, secret_scan
from graphquarry.llm.common import words_hashed


def test_kinds_of_secrets():
    texts = {
        "opaque": "x aB3dE5fG7hJ9kL1mN3pQ5rS7 y", "upper": "0123456789ABCDEF01", "vendor": "ghp_abcdefghij0123456789", "bearer": "Authorization: Bearer abc.def-ghi_0123456789",
        "url": "postgres://user:pa55word@host/db", "pem": "-----BEGIN RSA PRIVATE KEY-----\nMIIabc\n", "short": 'token = "abc123x"',
    }
    for kind, text in texts.items():
        assert kind in [k for k, _, _, base, _ in secret_scan.find_secrets(text) if not base], kind
    for text in ("plain words of no interest at all", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "123456789012345678901234567890", "token = secretive", "http://host:80/x", None, ""):
        assert not [k for k, _, _, base, _ in secret_scan.find_secrets(text) if not base], text


def test_ownership(spark):
    """Verdicts by both counts, as counted by hand; only live ones of the further kinds become spans."""
    secrets = [f"aB{i}cD{i}eF{i}gH{i}iJ{i}kL{i}mN{i}zQ7" for i in range(4)]
    where = [(0, ["a"]), (0, ["a"]), (1, ["a", "b", "c"]), (2, ["a", "b"]), *[(3, ["a"])] * 13]
    rows, n = [], 0
    for s, owners in where:
        for owner in owners:
            rows.append((n, owner, f"key {secrets[s]} and"))
            n += 1
    rows += [(n, None, None), (n + 1, "d", ""), (n + 2, None, 'token = "abcdefghijkl12"')]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").unionByName(spark.createDataFrame([rows[0]], "doc_id long, source string, text string"))
    owners, repositories = collections.defaultdict(set), collections.defaultdict(set)
    for doc, owner, text in rows:
        for _, _, _, _, h in secret_scan.find_secrets(text):
            owners[h].add(owner), repositories[h].add(doc)
    want = lambda h: "example" if len(owners[h]) >= 3 or len(repositories[h]) >= 12 else "live" if len(owners[h]) <= 1 and len(repositories[h]) <= 3 else "unclear"
    found = secret_scan.secret_spans(docs).collect()
    assert len(found) == 22 and all((r["verdict"], r["n_owners"], r["n_repositories"]) == (want(r["hash"]), len(owners[r["hash"]]), len(repositories[r["hash"]])) for r in found)
    assert {r["verdict"] for r in found} == {"live", "unclear", "example"}
    report = collections.Counter((r["doc_id"], r["spans"]) for r in secret_scan.secret_report(docs).collect())
    end = 4 + len(secrets[0])
    assert report[0, f"opaque:4:{end}"] == 2 and report[2, ""] == 1 and report[n + 2, "assign:0:23"] == 1 and sum(report.values()) == len(rows) + 1


def test_reliabilities_find_who_is_right():
    rng = np.random.default_rng(3)
    truth, right = rng.random(20_000) < 0.4, (0.95, 0.8, 0.65)
    votes = collections.Counter()
    for t in truth:
        votes["".join("-" if rng.random() < 0.2 else "P" if (rng.random() < r) == t else "N" for r in right)] += 1
    post = pii.reliabilities(sorted(votes.items()), 0.4)
    exact = {}
    for p in votes:
        odds = math.log(0.4 / 0.6) + sum({"P": 1, "N": -1, "-": 0}[c] * math.log(r / (1 - r)) for c, r in zip(p, right, strict=True))
        exact[p] = 1 / (1 + math.exp(-odds))
    assert sum(n * abs(post[p] - exact[p]) for p, n in votes.items()) / 20_000 < 0.06


def test_classifier_is_the_posterior_of_its_cells():
    cells = [("a|1|s|s|1|1", 50.0, 0.9), ("a|1|s|s|0|0", 50.0, 0.1), ("b|1|s|s|1|1", 20.0, 0.95)]
    model = pii.span_classifier(cells)
    assert model["a|1|s|s|1|1"] > 0.5 > model["a|1|s|s|0|0"] and model["b|1|s|s|1|1"] > 0.5


def test_what_labelers_propose(spark):
    text = "Dear Dr. Jane Doe, 12 Long Oak Street, born on 1980-02-03, account 123456789012 and a.b@mail.example.com"
    assert {k: text[a:b] for k, a, b, base, _, _ in pii.candidates(text) if not base} == {"name": "Jane Doe", "street": "12 Long Oak Street", "birth": "1980-02-03", "account": "123456789012"}
    near = "write to x.y@mail.example.com or 1234 5678 9012 3456 now"
    alone = "the part 1234567890123457 page"
    rows = [(i, f"{near} {i}") for i in range(40)] + [(100 + i, f"{alone} {i}") for i in range(40)] + [(200, None), (201, "")]
    found = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3]["n_email"] == 1 and found[3]["n_added"] == 1 and found[103]["n_added"] == 0 and found[200]["spans"] == found[201]["spans"] == ""


def test_counts_of_words(spark):
    """The table tells how often words come to a sixteenth of a doubling; words of one class cost by their own counts."""
    rows = [(i, " ".join(["common"] * 3 + [f"often{i % 7}"] * 2 + [f"rare{i}"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = collections.Counter(w for _, t in rows for w in t.split())
    table = lm_score.count_table(lm_score.vocabulary(docs))
    for word, n in count.items():
        got = float(lm_score.log_counts(table, words_hashed(word.encode()))[0])
        assert abs(got - math.log(n)) < 0.05 or got > math.log(n), word
    probe = spark.createDataFrame([*rows, (1000, "often3"), (1001, "rare5"), (1002, None), (1003, "")], "doc_id long, text string")
    own = [r["word"] for r in lm_score.vocabulary(probe).orderBy("n", ascending=False).limit(5).collect()]
    assert words_hashed(b"common").view(np.int64)[0] in own
    found = {r["doc_id"]: r for r in lm_score.pseudo_likelihood(probe).collect()}
    assert found[1002]["per_token"] is None and found[1003]["log_prob"] == 0 and found[0]["n_tokens"] == 6


@pytest.mark.parametrize("frequent", [1 << 20, 20])
def test_words_that_share_a_slot_keep_their_counts(spark, monkeypatch, frequent):
    """Scores of texts that differ in one word differ by the logarithms of its exact counts, however small the tables are."""
    monkeypatch.setattr(lm_score, "SLOTS", (3, 3))
    monkeypatch.setattr(lm_score, "FREQUENT", frequent, raising=False)
    count = {f"own{i}": 300 for i in range(40)} | {f"rest{i}": 1 + i % 19 for i in range(200)}
    rows = [(i, w) for i, w in enumerate(w for w, n in count.items() for _ in range(n - 1))]
    ids = {w: len(rows) + i for i, w in enumerate(count)}
    docs = spark.createDataFrame([*rows, *((i, f"own1 {w} own2") for w, i in ids.items())], "doc_id long, text string")
    own = [r["word"] for r in lm_score.vocabulary(docs).orderBy("n", ascending=False).limit(40).collect()]
    seen = collections.Counter(w for _, x in rows for w in x.split()) + collections.Counter(w for x in ids for w in ("own1", x, "own2"))
    found = {r["doc_id"]: r["log_prob"] for r in lm_score.pseudo_likelihood(docs).collect()}
    by_class = collections.defaultdict(list)
    for w in ids:
        by_class[int(lm_score.Classes(own).of(words_hashed(w.encode()))[0])].append(w)
    pairs = [(a, b) for c, (a, *others) in by_class.items() if c > 40 for b in others]
    assert len(pairs) > 100
    for a, b in pairs:
        assert abs(found[ids[a]] - found[ids[b]] - math.log(seen[a] / seen[b])) < 0.001, (a, b)


def test_probabilities_of_middle_words_sum_to_one():
    counts = np.random.default_rng(1).integers(0, 5, lm_score.CLASSES**3)
    p = np.exp(lm_score.Network(counts, steps=3).log_p.reshape(-1, lm_score.CLASSES).astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_blocks_of_a_mix(spark):
    """Each source gives its target to the word, pieces are cut from documents as they are, and no document gives over three times itself."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    rows = [(i, "abc"[i % 3], "\n ".join(f"w{i}x{j}" for j in range(20 + 37 * (i % 11)))) for i in range(120)] + [(900, None, "  lead\tand   trail "), (901, "a", None), (902, "a", ""), (0, "a", "again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumnRenamed("source", "source")
    mix = mixing.Mix(docs, length=16, shard=64, texts=True)
    blocks = mix.blocks().collect()
    size = collections.Counter()
    for _, s, t in rows:
        size[s] += len(word.findall(t or ""))
    taken = collections.Counter()
    for b in blocks:
        assert len(word.findall(b["text"])) == b["n_words"] <= 16
        taken[b["source"]] += b["n_words"]
    for r in mix.table:
        assert taken[r["source"]] == int(r["target"] + 1e-6) and r["source_size"] == size[r["source"]]
    texts = {i: t for i, _, t in rows if t}
    whole = [b for b in blocks if len(b["doc_ids"]) == 1]
    assert whole and all(b["text"].strip() in texts[b["doc_ids"][0]] or b["doc_ids"][0] == 0 for b in whole)
    report = mixing.Mix(docs, length=16, shard=64).taken().collect()
    assert len(report) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in report)
    slots = {(b["shard"], b["slot"]) for b in blocks}
    assert len(slots) == len(blocks)


def test_kept_documents_are_those_of_the_report(spark):
    rows = [(i, " ".join(f"word{(i * j) % 97}" for j in range(80))) for i in range(30)] + [(50, "too short"), (51, None), (52, "same " * 200), (52, "same " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in quality.keep_good(docs).collect())
    assert kept == sorted(r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()) and 50 not in kept


@pytest.mark.parametrize("report", [secret_scan.secret_report, pii.pii_report, lm_score.pseudo_likelihood, lambda d: mixing.Mix(d).taken(), quality.quality_report])
def test_very_long_texts(spark, report):
    long = " ".join(f"wort{i % 3001}" for i in range(200_000))
    docs = spark.createDataFrame([(1, "a", long), (2, "b", "x" * 500_000), (3, "b", "1" * 300_000)], "doc_id long, source string, text string")
    assert report(docs).count() == 3


def test_workers_of_the_join_give_back_memory(spark, monkeypatch):
    """What a worker has used to count, merge or compare is given back at the end, as Spark keeps it for the next stage."""
    import numpy as np
    import pandas as pd

    from graphquarry.llm import ngram_join

    calls = []
    monkeypatch.setattr(ngram_join, "trim", lambda: calls.append(1))
    count, merge = ngram_join._counting(lambda raw: ngram_join.shingles(raw, 2), 7, 16)
    parts = list(count(iter([pd.DataFrame({"text": [b"a b c d", b"a b c e"]})])))
    assert len(calls) == 2
    rows = pd.concat(parts)
    found = [merge((b,), part) for b, part in rows.groupby("bucket")]
    assert len(calls) == 2 + len(found) and len(found) == len(set(rows["bucket"]))
    sets = pd.Series([np.arange(8, dtype=np.uint64).tobytes()])
    assert list(ngram_join._linked(75).func(sets, sets)) == [True] and len(calls) == 3 + len(found)
