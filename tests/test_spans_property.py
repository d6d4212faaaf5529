"""Span search against a direct Python enumeration (ties, nesting rule, subword growth)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import spans as S


def brute_force(tokens, start, end, num_spans, max_len, allow_overlap):
    n = len(start)
    cands = [(s, e) for s in range(n) for e in range(s, min(s + max_len, n))]
    cands.sort(key=lambda se: -(start[se[0]] + end[se[1]]))        # stable: (s, e) order on ties
    chosen = []
    for s, e in cands:
        if not allow_overlap and any((s <= cs and ce <= e) or (cs <= s and e <= ce) for cs, ce, _, _ in chosen):
            continue
        gs, ge = s, e
        while gs > 0 and tokens[gs].startswith("##"):
            gs -= 1
        while ge < n - 1 and tokens[ge + 1].startswith("##"):
            ge += 1
        chosen.append((gs, ge, start[s], end[e]))
        if len(chosen) == num_spans:
            break
    return chosen


case = st.integers(min_value=1, max_value=9).flatmap(lambda n: st.tuples(
    st.lists(st.sampled_from(["w", "x", "##p", "##q"]), min_size=n, max_size=n),
    st.lists(st.integers(-2, 2).map(float), min_size=n, max_size=n),
    st.lists(st.integers(-2, 2).map(float), min_size=n, max_size=n),
    st.integers(1, 4), st.integers(1, 4), st.booleans()))


@settings(max_examples=6, deadline=None)
@given(cases=st.lists(case, min_size=20, max_size=20))
def test_best_spans_matches_brute_force(spark, cases):
    rows = [(i, t, s, e) for i, (t, s, e, _, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, t array<string>, s array<double>, e array<double>")
    # one Spark pass per parameter combination used in this batch of cases
    for n_sp, mx, ov in {(c[3], c[4], c[5]) for c in cases}:
        got = df.select("i", S.best_spans("t", "s", "e", num_spans=n_sp, max_answer_length=mx,
                                          allow_overlap=ov).alias("b")).collect()
        got = {r["i"]: [(x["start"], x["end"], x["start_logit"], x["end_logit"]) for x in r["b"]] for r in got}
        for i, (t, s, e, a, b, c) in enumerate(cases):
            if (a, b, c) == (n_sp, mx, ov):
                assert got[i] == brute_force(t, s, e, n_sp, mx, ov), (t, s, e, n_sp, mx, ov)
