"""A record holding a third of all rows: results stay exact (brute force)."""

import random
from collections import defaultdict

from aspectspark.operators import metrics, vote
from tests.test_hand_cases import _brute_set_match, _flat

ASPECTS = [f"T{t}#C{c}" for t in range(4) for c in range(7)]
POLS = ["positive", "negative", "neutral"]


def _brute_vote(rows, t=2):
    out = {}
    by_id = defaultdict(list)
    for m, i, p, a, pol in sorted(rows):
        by_id[i].append((a, pol))
    for i, anns in by_id.items():
        ac, pc = {}, {}
        for a, pol in anns:                    # insertion order = (member, pos)
            ac[a] = ac.get(a, 0) + 1
            pc[pol] = pc.get(pol, 0) + 1
        mx = max(ac.values())
        best = max(pc.values())
        use = next(k for k, v in pc.items() if v == best)
        out[i] = [(a, use) for a, v in ac.items() if v >= min(mx, t)]
    return out


def test_hot_record_vote_and_metrics(spark):
    rnd = random.Random(3)
    rows = []
    for m in range(5):
        for i in range(300):
            n = 400 if i == 0 else rnd.randint(0, 4)      # record 0: ~a third of all rows
            for p in range(n):
                rows.append((m, i, p, rnd.choice(ASPECTS), rnd.choice(POLS)))
    df = spark.createDataFrame(rows, "member int, id int, pos int, aspect string, polarity string")
    got = {r.id: [(a.aspect, a.polarity) for a in r.annotation]
           for r in vote.hard_vote(df.repartition(6)).collect()}
    assert got == _brute_vote(rows)

    gold = defaultdict(list)
    pred = defaultdict(list)
    for m, i, p, a, pol in sorted(rows):
        if m == 0:
            gold[i].append((a, pol))
        elif m == 1:
            pred[i].append((a, pol))
    c = metrics.set_match_counts(_flat(spark, gold), _flat(spark, pred)).first().asDict()
    assert c == _brute_set_match(gold, pred)
