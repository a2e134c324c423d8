"""Two-branch knots, exact envelope draws and moves against the common target, all against listing every expression."""

import math

import numpy as np
import pytest

from quillon.operators import certify, envelope, grammar, knot
from quillon.operators.gram import Prior, Stats, Structure, conjugate
from quillon.operators.grammar import Grammar
from quillon.operators.openmc import sites

PRIOR = Prior(0.0, 0.7, 3.0, 0.08)


@pytest.fixture(scope="module")
def data():
    x = np.linspace(-1.4, 1.4, 7)[:, None]
    return x, 0.15 + 0.7 * x[:, 0] + 0.2 * x[:, 0] ** 2 + 0.1 * np.cos(9 * x[:, 0])


def fit(e, x, y):
    f = grammar.evaluate(e, x) * np.ones(len(y))
    return conjugate(Structure("f", ("f",), 1.0), Stats(("f",), float(len(y)), np.array([[f @ f]]), np.array([f @ y]), float(y @ y)), PRIOR).log_evidence


@pytest.fixture(scope="module")
def evidence(data):
    x, y = data
    held = {}

    def of(key):
        if key not in held:
            f = sum((c * np.prod(x ** np.array(p), axis=1) for p, c in key), np.zeros(len(y)))
            held[key] = conjugate(Structure("f", ("f",), 1.0), Stats(("f",), float(len(y)), np.array([[f @ f]]), np.array([f @ y]), float(y @ y)), PRIOR).log_evidence
        return held[key]

    return of


def test_slice(data):
    x, y = data
    s = knot.Slice(Grammar(1, 0.4), 5, x, y, PRIOR)
    assert len(s.expressions) == 154  # a fixed value: 2, 2, 10, 26, 114 expressions of the first sizes
    assert s.log_marginal(len(y), 0.0) == pytest.approx([fit(e, x, y) for e in s.expressions], abs=1e-10)
    assert s.log_marginal(3, 1.0) == pytest.approx(s.log_marginal(4, 0.0), abs=1e-12) and s.posterior().sum() == pytest.approx(1.0)


@pytest.mark.parametrize("method", knot.METHODS)
def test_knot_populations(data, method):
    """Every way estimates the slice's evidence without bias and its posterior, with the same work."""
    s = knot.Slice(Grammar(1, 0.4), 5, *data, PRIOR)
    got = [knot.run(s, 200, seed, method) for seed in range(60)]
    z = np.array([r["log_evidence"] for r in got]) - s.log_evidence()
    assert abs(math.log(np.exp(z).mean())) < 4 * np.exp(z).std() / math.sqrt(60) + 0.01
    assert abs(math.log(np.exp(z).mean())) < 0.15
    # Weighted by their evidence, the runs' estimates are unbiased up to their common factor; one run's own shares aren't.
    mean = np.average([r["probabilities"] for r in got], axis=0, weights=np.exp(z))
    assert 0.5 * np.abs(mean - s.posterior()).sum() < 0.12
    assert {(r["potentials"], r["proposals"]) for r in got} == {(200 * 7 * 4, 200 * 7)}
    assert all(r["probabilities"].sum() == pytest.approx(1.0) for r in got)


def test_knot_takes_noise_out(data):
    """Weights of the knot don't depend on the branch that is drawn."""
    s = knot.Slice(Grammar(1, 0.4), 5, *data, PRIOR)
    spread = {m: np.std([knot.run(s, 100, seed, m)["log_evidence"] for seed in range(120)]) for m in ("standard", "knot")}
    assert spread["knot"] < spread["standard"] * 1.05
    for bad in ({"method": "other"}, {"n": 1}, {"betas": (0.5, 0.4, 1.0)}, {"betas": (0.5, 0.9)}):
        with pytest.raises(ValueError):
            knot.run(s, **{"n": 10, "seed": 1, **bad})


def test_envelope_draws(evidence, data):
    """Frequencies against the law, log masses that sum to one, and one constant for all listed draws."""
    g, most = Grammar(1, 0.4), 3
    env = envelope.Envelope(g, most, evidence, certify.uniform_log_bound(7.0, PRIOR))
    listed = [e for n in range(1, most + 1) for e in g.expressions(n)]
    assert math.fsum(math.exp(env.masses(e).log_proposal) for e in listed) == pytest.approx(env.listed_probability, abs=1e-12)
    rng = np.random.default_rng(5)
    draws = [env.draw(rng) for _ in range(6000)]
    assert all(abs(d.log_target - d.log_proposal - env.log_total) < 1e-9 if d.listed else d.log_target - d.log_proposal <= env.log_total for d in draws)
    seen = {}
    for d in draws:
        seen[d.expression] = seen.get(d.expression, 0) + 1
    for e in listed:
        p = math.exp(env.masses(e).log_proposal)
        assert abs(seen.get(e, 0) - 6000 * p) < 5 * math.sqrt(6000 * p) + 1
    assert abs(sum(d.listed for d in draws) - 6000 * env.listed_probability) < 5 * math.sqrt(6000 * 0.25)
    shell = [e for e in seen if grammar.size(e) == most + 1]
    assert len(shell) > 15 and len(set(shell)) <= g.count(most + 1)
    estimate = np.mean([math.exp(d.log_target - d.log_proposal) for d in draws])
    core = math.exp(env.log_total) * env.listed_probability
    assert core <= estimate * 1.05 and estimate <= math.exp(env.log_total)


def test_common_target_balance(evidence):
    """Subtree moves on a finite slice leave the target in balance to rounding."""
    g, most = Grammar(1, 0.4), 3
    states = [e for n in range(1, most + 1) for e in g.expressions(n)]
    at = {e: k for k, e in enumerate(states)}
    logs = np.array([math.log(g.prior(grammar.size(e))) + evidence(grammar.polynomial_key(e, 1)) for e in states])
    pi = np.exp(logs - np.logaddexp.reduce(logs))
    p = np.zeros((len(states), len(states)))
    for e in states:
        for site in sites(e):
            for new in states:
                t = envelope.common_transition(g, evidence, e, site, new)
                if t.proposed in at:
                    assert t.log_acceptance <= 0 and t.log_target_current == pytest.approx(logs[at[e]])
                    p[at[e], at[t.proposed]] += t.forward * math.exp(t.log_acceptance)
    flow = pi[:, None] * p
    assert np.abs(flow - flow.T).max() < 2e-15 and p.sum(axis=1).max() <= 1 + 1e-12


def test_mixed_chain_on_the_whole_target(evidence):
    """Among the states of a size that is listed, a chain of both moves holds each class as long as its share of the listed evidence."""
    g = Grammar(1, 0.4)
    bound = certify.uniform_log_bound(7.0, PRIOR)
    env = envelope.Envelope(g, 5, evidence, bound)
    states, moved = envelope.chain(env, ("one",), 12_000, np.random.default_rng(11))
    assert moved > 300
    wide = envelope.Envelope(g, 6, evidence, bound)
    share, short = {}, [e for e in states[500:] if grammar.size(e) <= 6]
    for e in short:
        k = grammar.polynomial_key(e, 1)
        share[k] = share.get(k, 0.0) + 1 / len(short)
    core = {k: wide.log_mass[k] + evidence(k) for k in wide.keys}
    top = np.logaddexp.reduce(list(core.values()))
    for k in sorted(core, key=core.get)[-3:]:
        assert share.get(k, 0.0) == pytest.approx(math.exp(core[k] - top), abs=0.12)
