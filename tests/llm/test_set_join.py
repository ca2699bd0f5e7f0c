"""The near-duplicates of the pipeline against all pairs: crowds, recall at any size, and the exact bound."""

import random

import pytest

from motecraft.llm import set_join, simhash_ball

DOCS = "doc_id long, text string"


def words(rng, n):
    return ["".join(rng.choices("etaoinshr", k=rng.randint(4, 8))) for _ in range(n)]


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return sorted(r["doc_id"] for r in simhash_ball.one_of_each(docs).collect())


def brute(texts):
    sets = [frozenset(tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))) for t in map(str.split, texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return sorted(set(group))


def test_copies_within_a_crowd_that_shares_a_passage(spark):
    rng = random.Random(21)
    passage = words(rng, 200)
    crowd = [" ".join([*passage, *words(rng, 40)]) for _ in range(150)]
    copies = [" ".join(t.split()[:-6]) for t in crowd[::3]]
    assert kept(spark, crowd + copies) == brute(crowd + copies) == list(range(150))


@pytest.mark.parametrize("size", [200, 3000])
def test_every_pair_just_above_the_bound_is_found_at_any_size(spark, size):
    rng = random.Random(22)
    texts = [" ".join(words(rng, 104)) for _ in range(size)]
    # of 100 shingles the first 89 stay: 89 of 111 are shared, 0.8018
    texts += [" ".join(t.split()[:93] + words(rng, 11)) for t in texts[:100]]
    assert kept(spark, texts) == list(range(size))


def test_texts_just_below_the_bound_stay(spark):
    rng = random.Random(23)
    texts = [" ".join(words(rng, 104)) for _ in range(100)]
    # of 100 shingles the first 88 stay: 88 of 112 are shared, 0.786
    texts += [" ".join(t.split()[:92] + words(rng, 12)) for t in texts]
    assert kept(spark, texts) == list(range(200))


def test_chains_and_crossed_groups_match_all_pairs(spark):
    rng = random.Random(24)
    texts = []
    for _ in range(8):
        now = words(rng, 80)
        for _ in range(20):
            at = rng.randrange(80)
            now = [*now[:at], *words(rng, rng.choice((1, 1, 3))), *now[at + 1 :]]
            texts.append(" ".join(now))
    rng.shuffle(texts)
    assert kept(spark, texts) == brute(texts)


def test_altered_copies_that_are_similar_to_their_original_only(spark):
    rng = random.Random(25)
    original = words(rng, 120)
    texts = [" ".join(original)]
    for _ in range(150):
        # two altered words far apart take ten shingles of 116: 106 of 126 are shared, 0.84, and between copies 96 of 136
        now, at = list(original), rng.randrange(5, 55)
        now[at], now[at + 60] = words(rng, 2)
        texts.append(" ".join(now))
    rng.shuffle(texts)
    assert kept(spark, texts) == brute(texts) == [0]


def test_prefix_lengths():
    least = set_join.Fraction("0.8")
    assert [set_join.prefix_length(n, least) for n in (0, 1, 4, 5, 6, 100)] == [0, 1, 1, 2, 2, 21]


def of_sets(spark, sets):
    """Rows as of the sets' prefixes in one order, each set a component of its own."""
    rows = [(key, fp, len(keys), at, fp, [int(w) for w in set_join._sketch(set_join.np.array(keys, "uint64")).view("int64")]) for fp, keys in enumerate(sets) for at, key in enumerate(sorted(keys))]
    return set_join._with_earlier(spark.createDataFrame(rows, "key long, fp long, n long, at long, component long, sketch array<long>"))


def test_a_pair_that_shares_many_shingles_is_looked_at_few_times_and_never_missed(spark):
    rng = random.Random(26)
    crowd = [rng.sample(range(100, 140), 30) for _ in range(12)] + [[k, 500 + k, *range(1000 + 20 * k, 1008 + 20 * k)] for k in range(4)] + [[k, 600 + k] for k in range(4)]
    found = [(r["a"], r["b"]) for r in set_join._apart(of_sets(spark, crowd), set_join.F.lit(True)).collect()]
    sharing = {(a, b) for b in range(len(crowd)) for a in range(b) if set(crowd[a]) & set(crowd[b])}
    assert set(found) == sharing and len(found) < 2 * len(sharing)


def test_places_of_small_sets_rule_out_the_dissimilar_and_no_similar_pair(spark):
    rng = random.Random(27)
    h = [rng.getrandbits(63) for _ in range(5000)]
    pairs = [(h[4000 + 90 * k :][: 9 * k], h[4000 + 91 * k :][: 9 * k]) for k in range(1, 7)] + [([*h[:1], *h[100 * k : 100 * k + 40]], [*h[:1], *h[100 * k + 50 : 100 * k + 90]]) for k in range(1, 40)]
    left = of_sets(spark, [s for pair in pairs for s in pair])
    allowed = {(r["a"], r["b"]) for r in set_join._apart(left, set_join._not_ruled_out(set_join.Fraction("0.8"))).collect()}
    assert allowed == {(2 * k, 2 * k + 1) for k in range(6)}
