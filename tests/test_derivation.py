"""The keywords of several people against the same derivation row by row."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gristmill.operators import derivation as D

SENIOR, HARD, CONCEPTS = ("senior", "lead"), ("intern",), ("patterns",)
RULES = D.Rules(weight=3.0, companies=2, skill_lift=1.5, orphan_listings=4, orphan_companies=2, represented=0.4, rows=4, evidence=0.2, keywords=6)


def frags(title):
    w = [x for x in re.findall(r"[a-z0-9+#.]+", title) if x not in SENIOR]
    return {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}


def greedy(words, most):
    out = []
    for w in words:
        if len(out) < most and not any(w in x or x in w for x in out):
            out.append(w)
    return out


def slow(owned, held, rows, R):
    total, titles = len(rows), Counter(t for t, *_ in rows)
    vocab = Counter(s for *_, sk in rows for s in sk)
    employers = {s: len({c for _, _, c, sk in rows if s in sk and c}) for s in vocab}
    idf = {s: math.log(total / (1 + n)) for s, n in vocab.items()}
    index = {f: (sum(n for t, n in titles.items() if f in frags(t)), len({c for t, _, c, _ in rows if f in frags(t) and c})) for t in titles for f in frags(t)}

    def canonical(f):
        fit = [(any(w in SENIOR for w in t.split()), -n, len(t.split()), t) for t, n in titles.items() if f in t and 2 <= len(t.split()) <= 4]
        if not fit:
            return None
        senior, *_, t = min(fit)
        plain = " ".join(w for w in t.split() if w not in SENIOR)
        return t if not senior else plain if plain in titles else None

    def wants(title, skill):
        mine = [r for r in rows if title in r[0]]
        share = sum(skill in r[3] for r in mine) / len(mine)
        return len(mine), share, share / (vocab[skill] / total), share * idf[skill]

    by_skill = {}
    for s in vocab:
        here = Counter(f for t, _, _, sk in rows if s in sk for f in frags(t))
        found = []
        for f, n in sorted(here.items(), key=lambda x: (-x[1], x[0]))[: R.top]:
            if n >= R.of_skill * vocab[s] and index[f][1] >= R.orphan_companies and index[f][0] <= R.share * total and (t := canonical(f)) and t not in found and wants(t, s)[2] >= R.skill_lift:
                found.append(t)
        by_skill[s] = greedy(found, R.titles)
    out = {}
    for person in owned:
        own = {s for s in owned[person] if s in vocab or not set(s.split()) & set(CONCEPTS)}
        met = [(r, sum(idf[s] for s in own & set(r[3]))) for r in rows if len(own & set(r[3])) >= R.shared]
        if any(e >= R.strong for _, e in met):
            met = [(r, e) for r, e in met if e >= R.strong]
        weight, reach, whole = Counter(), Counter(), sum(max(1.0, e) for _, e in met)
        for (t, score, *_), e in met:
            for f in frags(t):
                weight[f] += max(1.0, e)
                reach[f] += max(1.0, e) * (score >= 20)
        scored = []
        for f, w in weight.items():
            share = index[f][0] / total
            if w >= R.weight and index[f][1] >= R.companies and share <= R.share and (w / whole) / share > 1 + 1e-12:
                scored.append((-round(w / whole / share * reach[f] / w, 9), -round(w, 9), f))
        corpus = []
        for f in greedy([f for *_, f in sorted(scored)], R.keywords):
            if (t := canonical(f)) and t not in corpus:
                corpus.append(t)
        both = list(dict.fromkeys(held.get(person, []) + corpus))
        bad = [k for k in both if sum(k in t for t, *_ in rows) > R.share * total or set(re.sub("[-.]", " ", k).split()) & set(HARD)]
        base = [] if both and len(bad) > 0.5 * len(both) else [k for k in both if k not in bad]
        bought = [r for r in rows if any(k in r[0] for k in base)]
        lonely = sorted((sum(s in r[3] for r in bought) / len(bought) if bought else 0.0, -vocab[s], s) for s in own if vocab[s] >= R.orphan_listings and employers[s] >= R.orphan_companies)
        lonely = [s for share, _, s in lonely if share < R.represented and by_skill.get(s)][: R.orphans]
        found = {}
        for s in lonely:
            for t in by_skill[s]:
                n, *_, evidence = wants(t, s)
                if not any(t in b or b in t for b in base) and n >= R.rows and evidence >= R.evidence:
                    found[t] = max(found.get(t, (-1.0, "")), (round(evidence, 9), s))
        anchored = greedy(sorted(found, key=lambda t: (-found[t][0], t)), R.anchored)
        tier = {}
        for n, words in ((1, [k for k in base if k in held.get(person, [])]), (2, anchored), (3, [k for k in base if k not in held.get(person, [])])):
            for k in words:
                tier.setdefault(k, n)
        info = {}
        for k in tier:
            mine = [r for r in rows if k in r[0]]
            share = {s: (n + 20 * vocab[s] / total) / (len(mine) + 20) for s in own if (n := sum(s in r[3] for r in mine))}
            info[k] = (share, len(mine), len({r[2] for r in mine if r[2]}))
        fit = [k for k in tier if info[k][1] >= R.rows and info[k][2] >= R.orphan_companies]
        left = fit if len(fit) >= 2 else list(tier)
        thin, order, have = [k for k in tier if k not in left], [], {}
        gain = lambda k: round(sum(idf[s] * max(0, v - have.get(s, 0)) for s, v in info[k][0].items()), 9)
        leads = [k for k in left if tier[k] == 1]
        while left:
            best = max(leads or left, key=lambda k: (gain(k), info[k][1], k))
            if gain(best) <= 0 and not leads:
                break
            leads = []
            order.append(best)
            left.remove(best)
            for s, v in info[best][0].items():
                have[s] = max(have.get(s, 0), v)
        for place, k in enumerate(order + left + thin, 1):
            out[person, k] = (tier[k], place)
    return out


def test_derivation_equals_the_slow_one(spark):
    rng = random.Random(12)
    fields, roles, tools = ["data", "web", "mobile", "cloud"], ["engineer", "developer", "analyst"], ["spark", "react", "swift", "aws", "sql", "kafka", "vue", "kotlin"]
    rows = []
    for _ in range(400):
        f = rng.randrange(4)
        title = " ".join([*rng.choice([[], [], ["senior"], ["intern"]]), fields[f], *rng.choice([[], ["platform"]]), rng.choice(roles)])
        skills = {tools[f], rng.choice(tools[4:]), rng.choice([tools[f + 4], rng.choice(tools)])}
        rows.append((title, rng.choice([5, 25, 40]), rng.choice(["a", "b", "c", "d", None]), sorted(skills)))
    owned = {p: set(rng.sample(tools, rng.randint(1, 5))) | rng.choice([set(), {"design patterns"}, {"cobol"}]) for p in range(25)}
    held = {p: [rng.choice(["data analyst", "web platform developer", "intern analyst", "engineer", "shop clerk"])] for p in range(0, 25, 2)}
    right = slow(owned, held, rows, RULES)
    market = spark.createDataFrame(rows, "title string, score int, company string, skills array<string>")
    skills = spark.createDataFrame([(p, s) for p, ss in owned.items() for s in ss], "person long, skill string")
    titles = spark.createDataFrame([(p, k, n) for p, ks in held.items() for n, k in enumerate(ks, 1)], "person long, keyword string, place int")
    got = {(r["person"], r["keyword"]): (r["tier"], r["place"]) for r in D.derived(skills, titles, market, SENIOR, HARD, CONCEPTS, RULES).collect()}
    assert got == right and len({p for p, _ in got}) > 15 and {t for t, _ in got.values()} == {1, 2, 3}


def test_containment_equals_naive(spark):
    rng = random.Random(2)
    titles = list({"".join(rng.choices("ab c", k=rng.randint(0, 12))) for _ in range(150)})
    terms = list({"".join(rng.choices("ab c", k=rng.randint(1, 5))) for _ in range(60)})
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = sorted(map(tuple, D.held_in(df(titles, "title"), df(terms, "term")).collect()))
    assert got == sorted((k, t) for k in terms for t in titles if k in t)


def test_empty_market(spark):
    market = D.market_of(spark.createDataFrame([], "title string, score int, company string, skills array<string>"))
    own = spark.createDataFrame([(1, "x")], "person long, skill string")
    assert D.corpus_scores(own, market).count() == 0 and D.skill_titles(market).count() == 0
    assert D.profiled(own.select(F.col("skill").alias("term")), market).first()["share"] == 0


def test_redundant_keywords_wait(spark):
    rng = random.Random(7)
    rows, right = [], {}
    for person in range(12):
        skills = {s: rng.uniform(1, 5) for s in "abcd"}
        words = [(k, f"k{k}", k in (1, 4), {s: rng.choice([0.1, 0.5, 0.9]) for s in rng.sample("abcd", rng.randint(1, 3))}) for k in range(8)]
        keep, wait, have, lead = [], [], {}, 0
        for _, word, held, share in words:
            mine, gain = sum(skills[s] * v for s, v in share.items()), sum(skills[s] * max(0, v - have.get(s, 0)) for s, v in share.items())
            if held and lead or gain / mine < 1 - D.REDUNDANT:
                wait.append(word)
            else:
                keep.append(word)
                lead += held
                have = {s: max(have.get(s, 0), share.get(s, 0)) for s in "abcd"}
        right |= {(person, w): i for i, w in enumerate(keep + wait, 1)}
        rows += [(person, word, s, v, skills[s], held, k) for k, word, held, share in words for s, v in share.items()]
    df = spark.createDataFrame(rows, "person long, keyword string, skill string, share double, idf double, held boolean, rank long")
    got = {(r["person"], r["keyword"]): r["place"] for r in D.redundant_last(df).collect()}
    assert got == right and any(p > 1 and w == "k1" for (_, w), p in right.items())


def test_hints_are_fragments_with_their_titles(spark):
    rows = [("data engineer", 30, c, ["spark", "sql"]) for c in "abcdef"] + [("shop clerk", 5, c, ["till"]) for c in "abcdefgh"] * 3
    market = D.market_of(spark.createDataFrame(rows, "title string, score int, company string, skills array<string>"))
    own = spark.createDataFrame([(1, "spark"), (1, "sql")], "person long, skill string")
    hints = D.title_hints(D.corpus_scores(own, market, D.Rules(weight=1.0)), market)
    assert [tuple(r) for r in hints.collect()] == [(1, "data engineer", 1)]
