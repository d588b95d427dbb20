"""Next-symbol distributions, the role grammar and decoding, against plain versions."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import automaton as A
from lexstrata.operators import ngrams as N
from lexstrata.operators import readout as R

# The three records of prose that the behaviour is described on.
PROSE = [
    ("Frequenz", "Die Frequenz ist die Anzahl vollständiger Schwingungen pro Sekunde."),
    ("Frequenz", "Die Frequenz wird in Hertz gemessen."),
    ("Frequenz", "Die Frequenz ist der Kehrwert der Periodendauer."),
    ("Periodendauer", "Die Periodendauer ist die Dauer einer vollständigen Schwingung."),
    ("Periodendauer", "Die Einheit der Periodendauer ist die Sekunde."),
    ("Spannung", "Die Spannung ist eine elektrische Potentialdifferenz."),
    ("Spannung", "Die Spannung wird in Volt gemessen."),
]


def plain_interference(modes, p, wave, *, phase=0.0, data_gain=0.15, prompt_gain=1.0):
    energy = sum(a * a for a in modes.values())
    if energy <= 1e-24:
        return {}
    norm = math.sqrt(sum(wave.get(t, 0.0) ** 2 for t in modes))
    out = {}
    for t, a in modes.items():
        x = a / math.sqrt(energy)
        x = complex(x) * (1 + prompt_gain * p.get(t, 0.0) * complex(math.cos(phase), math.sin(phase))) * (1 + (data_gain * wave.get(t, 0.0) / norm if norm else 0.0))
        out[t] = abs(x) ** 2
    total = sum(out.values())
    out = {t: round(v / total, 12) for t, v in out.items()}
    return {t: v / sum(out.values()) for t, v in out.items()}


def plain_counts(sequences, order):
    counts = defaultdict(Counter)
    for group, tokens in sequences:
        line = [N.BOS] * order + tokens + [N.EOS]
        for i in range(order, len(line)):
            for d in range(order + 1):
                counts[group, tuple(line[i - d : i])][line[i]] += 1
    return counts


def plain_next(prefix, groups, counts, p, wave, order, policy="deepest", **gains):
    line = [N.BOS] * order + prefix
    found = []
    for d in range(order, -1, -1):
        found += [(g, tuple(line[len(line) - d :])) for g in groups if (g, tuple(line[len(line) - d :])) in counts]
        if found and policy == "deepest":
            break
    mixed = defaultdict(float)
    for key in found:
        total = sum(counts[key].values())
        modes = {t: math.sqrt(n / total) for t, n in counts[key].items()}
        overlap = sum(m * p.get(t, 0.0) for t, m in modes.items())
        for t, m in modes.items():
            mixed[t] += (0.25 + overlap) / math.sqrt(len(groups)) * m
    return plain_interference(mixed, p, wave, **gains)


def tokens(text):
    return text.lower().replace(".", " .").split()


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(PROSE)], "doc_id long, group string, text string")
    counts = N.transitions(docs, by=("group",))
    field = {0: {"frequenz": 1.0}, 1: {"frequenz": 0.6, "volt": 0.8}, 2: {"unbekannt": 1.0}}
    wave = {"frequenz": 0.5, "die": 0.7, "hertz": 0.1, "ist": 0.5}
    bound = {0: ["Frequenz"], 1: ["Frequenz", "Spannung"], 2: ["Periodendauer", "Spannung", "Frequenz"]}
    frames = {
        "counts": counts,
        "field": spark.createDataFrame([(i, t, a) for i, f in field.items() for t, a in f.items()], "prompt_id long, token string, amplitude double"),
        "wave": spark.createDataFrame(list(wave.items()), "token string, amplitude double"),
        "bound": spark.createDataFrame([(i, g) for i, gs in bound.items() for g in gs], "prompt_id long, group string"),
    }
    plain = plain_counts([(g, tokens(t)) for g, t in PROSE], 2)
    return frames, plain, field, wave, bound


def test_counts_by_group(model):
    frames, plain, *_ = model
    got = {(r["group"], r["prefix"], r["target"]): r["n"] for r in frames["counts"].collect()}
    assert got == {(g, " ".join(p), t): n for (g, p), c in plain.items() for t, n in c.items()}


@pytest.mark.parametrize("policy, gains", [("deepest", {}), ("all", {"phase": 0.7, "data_gain": 0.4}), ("deepest", {"phase": math.pi, "prompt_gain": 0.5})])
def test_next_distribution_equals_the_plain_version(spark, model, policy, gains):
    frames, plain, field, wave, bound = model
    prefixes = [[], ["die"], ["die", "frequenz"], ["eine", "spannung"], ["die", "einheit", "der"], ["qz", "qy"]]
    states = [(i, k, p) for i in bound for k, p in enumerate(prefixes)]
    got = defaultdict(dict)
    df = R.next_distribution(spark.createDataFrame(states, "prompt_id long, state long, tokens array<string>"), frames["bound"], frames["counts"], frames["field"], frames["wave"], policy=policy, **gains)
    for r in df.collect():
        got[r["prompt_id"], r["state"]][r["target"]] = r["probability"]
    for i, k, p in states:
        want = plain_next(p, bound[i], plain, field[i], wave, 2, policy, **gains)
        assert got[i, k].keys() == want.keys() and abs(sum(got[i, k].values()) - 1) < 1e-9
        assert all(abs(got[i, k][t] - v) < 1e-9 for t, v in want.items()), (i, p)


def test_prefixes_can_be_left_out(spark, model):
    frames, *_ = model
    states = spark.createDataFrame([(0, 0, ["die", "frequenz"])], "prompt_id long, state long, tokens array<string>")
    deep = R.fields_of(states, frames["bound"], frames["counts"]).collect()
    flat = R.fields_of(states, frames["bound"], frames["counts"], prefix_enabled=False).collect()
    assert [r["depth"] for r in deep] == [2] and [(r["depth"], r["prefix"]) for r in flat] == [(0, "")]
    with pytest.raises(ValueError):
        R.fields_of(states, frames["bound"], frames["counts"], policy="some")


def plain_beam(prompt, groups, counts, p, wave, width, steps):
    beams = [(0.0, [], False)]
    for _ in range(steps):
        grown = []
        for score, line, ended in beams:
            if ended:
                grown.append((score, line, True))
                continue
            chances = plain_next(line, groups, counts, p, wave, 2)
            seen = {tuple(line[i : i + 3]) for i in range(len(line) - 2)}
            chances = {t: v for t, v in chances.items() if len(line) < 2 or (*line[-2:], t) not in seen}
            whole = sum(chances.values())
            for t, v in sorted(chances.items(), key=lambda x: (-x[1], x[0]))[:width]:
                grown.append((score + math.log(v / whole), line + ([t] if t != N.EOS else []), t == N.EOS))
        beams = sorted(grown, key=lambda b: (-round(b[0], 12), b[1]))[:width]
        if all(b[2] for b in beams):
            break
    return ([b for b in beams if b[2]] or beams)[0]


@pytest.mark.parametrize("width", [1, 3])
def test_decoding_equals_the_plain_version(spark, model, width):
    frames, plain, field, wave, bound = model
    prompts = frames["bound"].select("prompt_id").distinct()
    got = {r["prompt_id"]: r for r in R.decode(prompts, frames["bound"], frames["counts"], frames["field"], frames["wave"], width=width, steps=9).collect()}
    for i in bound:
        score, line, ended = plain_beam(i, bound[i], plain, field[i], wave, width, 9)
        assert (got[i]["tokens"], got[i]["ended"]) == (line, ended) and abs(got[i]["score"] - score) < 1e-6


def test_no_trigram_comes_twice(spark):
    docs = spark.createDataFrame([(0, "g", "a b a b a b a b a b")], "doc_id long, group string, text string")
    bound = spark.createDataFrame([(0, "g")], "prompt_id long, group string")
    empty = spark.createDataFrame([], "prompt_id long, token string, amplitude double")
    line = R.decode(bound.select("prompt_id"), bound, N.transitions(docs, by=("group",)), empty, empty.drop("prompt_id"), width=1, steps=30).collect()[0]
    seen = [tuple(line["tokens"][i : i + 3]) for i in range(len(line["tokens"]) - 2)]
    assert len(seen) == len(set(seen)) and len(line["tokens"]) < 12


GRAMMAR = {  # prompt: segments of alternatives; evidence
    0: ([["guten tag", "guten abend", "hallo"], ["!"], ["wie geht es", "wie war der tag"], ["?"]], ["guten tag"]),
    1: ([["du"], ["heißt"], ["x y"], ["."]], ["x y", ""]),
    2: ([["du"], [""], ["."]], ["du"]),
    3: ([["ja"], ["."]], [""]),
}


def grammar_frames(spark):
    grammar = [(i, s, r) for i, (segments, _) in GRAMMAR.items() for s, rs in enumerate(segments) for r in rs]
    names = {(i, r) for i, (segments, evidence) in GRAMMAR.items() for rs in [*segments, evidence] for r in rs}
    roles = [(i, r, r.split(), [w.upper() for w in r.split()], "test") for i, r in names]
    return (
        spark.createDataFrame(grammar, "prompt_id long, segment int, role string"),
        spark.createDataFrame(roles, "prompt_id long, role string, tokens array<string>, shown array<string>, origin string"),
        spark.createDataFrame([(i, r) for i, (_, evidence) in GRAMMAR.items() for r in evidence], "prompt_id long, role string"),
    )


def plain_states(segments, prefix):
    def enter(s):
        return {(s, "", 0)} if s >= len(segments) else {(s, r, 0) for r in segments[s] if r}

    states = enter(0)
    for t in prefix:
        after = set()
        for s, r, k in states:
            w = r.split()
            if s < len(segments) and w[k] == t:
                after |= {(s, r, k + 1)} if k + 1 < len(w) else enter(s + 1)
        states = after
    return states


def plain_roles(segments, prefix, p, wave, **gains):
    modes = defaultdict(float)
    for s, r, k in plain_states(segments, prefix):
        modes[N.EOS if s >= len(segments) else r.split()[k]] += 1.0 if s >= len(segments) else 1 / math.sqrt(len(r.split()))
    return plain_interference(modes, p, wave, **gains) if modes else {}


def test_role_distribution_equals_the_plain_version(spark):
    grammar, roles, evidence = grammar_frames(spark)
    prefixes = [(0, 0, []), (0, 1, ["guten"]), (0, 2, ["guten", "abend"]), (0, 3, ["hallo", "!", "wie"]), (0, 4, ["hallo", "!", "wie", "war", "der", "tag", "?"]), (0, 5, ["nie"]), (1, 0, ["du", "heißt", "x"]), (1, 9, ["du", "heißt", "x", "y", "."]), (2, 0, []), (2, 1, ["du"]), (3, 0, [])]
    p, wave = {0: {"abend": 0.8, "geht": 0.6}, 1: {}}, {"guten": 0.9, "hallo": 0.1, "war": 0.4}
    field = spark.createDataFrame([(i, t, a) for i, f in p.items() for t, a in f.items()], "prompt_id long, token string, amplitude double")
    waves = spark.createDataFrame(list(wave.items()), "token string, amplitude double")
    for gains in ({}, {"phase": math.pi}):
        got = defaultdict(dict)
        for r in A.role_distribution(spark.createDataFrame(prefixes, "prompt_id long, state long, spoken array<string>"), grammar, roles, evidence, field, waves, **gains).collect():
            got[r["prompt_id"], r["state"]][r["target"]] = r["probability"]
        for i, k, prefix in prefixes:
            want = plain_roles(GRAMMAR[i][0], prefix, p.get(i, {}), wave, **gains) if any(GRAMMAR[i][1]) else {}
            assert got[i, k].keys() == want.keys() and all(abs(got[i, k][t] - v) < 1e-9 for t, v in want.items()), (i, prefix, gains)


def test_decoded_roles(spark):
    grammar, roles, evidence = grammar_frames(spark)
    field = spark.createDataFrame([(0, "abend", 1.0)], "prompt_id long, token string, amplitude double")
    waves = spark.createDataFrame([("guten", 1.0)], "token string, amplitude double")
    got = {r["prompt_id"]: r for r in A.decode_roles(grammar, roles, evidence, field, waves, width=3).collect()}
    assert got[0]["tokens"][:3] == ["guten", "abend", "!"] and got[0]["ended"] and got[0]["tokens"][-1] == "?" and got[0]["shown"][0] == "GUTEN"
    assert got[1]["tokens"] == ["du", "heißt", "x", "y", "."] and got[1]["ended"]
    assert 2 not in got  # an empty segment lets nothing past
    assert 3 not in got  # evidence without words licenses nothing


def test_unknown_words_become_bytes(spark):
    roles = spark.createDataFrame([(0, "a", ["Xö", "Yz", "Haus", "q"], "s"), (0, "b", [], "s")], "prompt_id long, role string, words array<string>, origin string")
    got = {r["role"]: r for r in A.encoded(roles, spark.createDataFrame([("haus",)], "token string")).collect()}
    assert got["a"]["tokens"] == ["<byte:58>", "<byte:c3>", "<byte:b6>", "<byte:20>", "<byte:59>", "<byte:7a>", "haus", "<byte:71>"]
    assert got["a"]["shown"][6] == "Haus" and got["b"]["tokens"] == []


def test_role_wave_has_unit_energy(spark):
    _, roles, _ = grammar_frames(spark)
    assert abs(A.role_wave(roles).agg(F.sum(F.col("amplitude") * F.col("amplitude"))).first()[0] - 1) < 1e-9
