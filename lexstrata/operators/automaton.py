"""The role grammar: a non-deterministic automaton over (segment, role, place), stepped by joins (G-2, G-3, Y13, Y14, X25, X26).

A grammar is rows (prompt_id, segment, role): at each segment one of its roles is spoken, word by word. Roles are rows
(prompt_id, role, tokens, shown, origin) with the spelling of each token. The active states of all prompts are one table, the
frontier; a token moves it by an equality of the token at each state's place, and where a role ends by a join with the roles
of the next segment. Evidence is rows (prompt_id, role): what is declared lends the grammar its energy, so a prompt whose
evidence has no words says nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import dropped, stored
from .ngrams import EOS
from .readout import LEAST_ENERGY, STATE, interfered

NFA = [*STATE, "segment", "role", "place", "tokens", "shown"]
NAMES = [*STATE, "target", "amplitude", "p"]
#: Rows of a batch; tokens with energies that a task holds before it sums them.
ROWS, HELD = 1 << 14, 1 << 21


def lanes_of(grammar: DataFrame, roles: DataFrame, last: int | None = None) -> DataFrame:
    """(prompt_id, segment, role, tokens, shown, segments): the roles with words that each segment offers (up to the segment
    ``last``, if given); ``segments`` is the number of the prompt's segments, those without such a role included (nothing gets
    past them)."""
    count = grammar.groupBy("prompt_id").agg((F.max("segment") + 1).alias("segments"))
    spoken = roles.where(F.size("tokens") > 0).select("prompt_id", "role", "tokens", "shown")
    offered = grammar if last is None else grammar.where(F.col("segment") <= last)
    return offered.select("prompt_id", "segment", "role").distinct().join(spoken, ["prompt_id", "role"]).join(count, "prompt_id")


def _enter(at: DataFrame, lanes: DataFrame, counts: DataFrame) -> DataFrame:
    """The states that open where rows (prompt_id, state, segment) stand: each role of the segment at its first word, or the
    end of the grammar (no role) after the last segment."""
    first = at.join(lanes.drop("segments"), ["prompt_id", "segment"]).withColumn("place", F.lit(0))
    past = at.join(counts, "prompt_id").where(F.col("segment") >= F.col("segments"))
    none = F.lit(None).cast("array<string>")
    end = past.select(*STATE, "segment", F.lit(None).cast("string").alias("role"), F.lit(0).alias("place"), none.alias("tokens"), none.alias("shown"))
    return first.select(*NFA).unionByName(end.select(*NFA))


def start(prompts: DataFrame, lanes: DataFrame) -> DataFrame:
    """The frontier of rows (prompt_id, state) before the first token."""
    counts = lanes.select("prompt_id", "segments").distinct()
    return _enter(prompts.select(*STATE, F.lit(0).alias("segment")), lanes, counts)


def stepped(frontier: DataFrame, spoken: DataFrame, lanes: DataFrame) -> DataFrame:
    """The frontier after one token of each state (prompt_id, state, token, following): the states that await it move on, and
    belong to ``following`` from then on. A state that offers no such token is gone."""
    awaits = frontier.where("role IS NOT NULL").join(spoken, STATE).where(F.get("tokens", F.col("place")) == F.col("token"))
    moved = awaits.withColumn("state", F.col("following")).withColumn("place", F.col("place") + 1)
    inside = moved.where(F.col("place") < F.size("tokens")).select(*NFA)
    ended = moved.where(F.col("place") >= F.size("tokens")).select(*STATE, (F.col("segment") + 1).alias("segment")).distinct()
    return inside.unionByName(_enter(ended, lanes, lanes.select("prompt_id", "segments").distinct()))


def after(prefixes: DataFrame, lanes: DataFrame) -> DataFrame:
    """The frontier of rows (prompt_id, state, spoken) after all tokens of ``spoken``; rows whose tokens leave the grammar have
    no state. Steps are as many as the longest prefix; shorter ones wait."""
    longest = prefixes.agg(F.max(F.size("spoken"))).first()[0] or 0
    frontier = stored(start(prefixes, lanes), "frontier")
    for k in range(longest):
        long = prefixes.where(F.size("spoken") > k)
        token = long.select(*STATE, F.get("spoken", F.lit(k)).alias("token"), F.col("state").alias("following"))
        waiting = frontier.join(long.select(*STATE), STATE, "left_anti")
        last, frontier = frontier, stored(waiting.select(*NFA).unionByName(stepped(frontier, token, lanes)), "frontier")
        dropped(last)
    return frontier


def gates(evidence: DataFrame, roles: DataFrame) -> DataFrame:
    """(prompt_id, gate): the energy of each prompt's evidence, the share of its roles that have words; none without any."""
    sized = evidence.select("prompt_id", "role").join(roles.select("prompt_id", "role", F.size("tokens").alias("n")), ["prompt_id", "role"], "left")
    return sized.groupBy("prompt_id").agg((F.count_if(F.coalesce(F.col("n") > 0, F.lit(False))) / F.count("*")).alias("gate")).where(F.col("gate") > LEAST_ENERGY)


def grammar_modes(frontier: DataFrame, gate: DataFrame) -> DataFrame:
    """(prompt_id, state, target, amplitude): what the active states await. A role spreads one unit of energy over its words; the
    end of the grammar awaits the end token; a state's modes have the energy of its prompt's gate together."""
    ends = F.col("role").isNull()
    awaited = frontier.join(gate, "prompt_id").select(*STATE, "gate", F.when(ends, F.lit(EOS)).otherwise(F.get("tokens", F.col("place"))).alias("target"), F.when(ends, 1.0).otherwise(1 / F.sqrt(F.size("tokens"))).alias("value"))
    summed = awaited.groupBy(*STATE, "gate", "target").agg(F.sum("value").alias("value"))
    energy = summed.groupBy(*STATE).agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    return summed.join(energy, STATE).select(*STATE, "target", (F.col("value") * F.sqrt(F.col("gate") / F.col("energy"))).alias("amplitude"))


def role_distribution(prefixes: DataFrame, grammar: DataFrame, roles: DataFrame, evidence: DataFrame, field: DataFrame, wave: DataFrame, **gains: float) -> DataFrame:
    """G-2: (prompt_id, state, target, probability) of the next symbol after each prefix (prompt_id, state, spoken)."""
    prefixes = stored(prefixes, "prefixes")
    # a role has a word at least, so no prefix gets past as many segments as it has tokens
    longest = prefixes.agg(F.max(F.size("spoken"))).first()[0] or 0
    lanes, gate = stored(lanes_of(grammar, roles, longest), "lanes"), stored(gates(evidence, roles), "gates")
    modes = stored(grammar_modes(after(prefixes, lanes), gate), "modes")
    # of field and wave only what is awaited
    heard = field.join(modes.select("prompt_id", F.col("target").alias("token")).distinct(), ["prompt_id", "token"], "left_semi")
    own = wave.join(modes.select(F.col("target").alias("token")).distinct(), "token", "left_semi")
    return interfered(modes, stored(heard, "heard"), stored(own, "own-wave"), **gains)


def decode_roles(grammar: DataFrame, roles: DataFrame, evidence: DataFrame, field: DataFrame, wave: DataFrame, *, width: int = 4, steps: int = 64, **gains: float) -> DataFrame:
    """(prompt_id, tokens, shown, score, ended): the best sequence of each prompt's grammar by beam search, with the spelling of
    each token. Finished beams stay and win; prompts without evidence give no row."""
    if not 1 <= width <= 16 or not 1 <= steps <= 256:
        raise ValueError("width must be 1 to 16 and steps 1 to 256")
    lanes, gate = stored(lanes_of(grammar, roles), "lanes"), stored(gates(evidence, roles), "gates")
    none = F.array().cast("array<string>")
    kept = beams = stored(grammar.select("prompt_id").distinct().select("prompt_id", F.lit(1).cast("long").alias("state"), none.alias("tokens"), none.alias("shown"), F.lit(0.0).alias("score"), F.lit(False).alias("ended")), "beams")
    frontier = stored(start(beams, lanes), "frontier")
    top = Window.partitionBy(*STATE).orderBy(F.desc("probability"), "target")
    best = Window.partitionBy("prompt_id").orderBy(F.desc(F.round("score", 12)), "tokens")
    for _ in range(steps):
        chances = interfered(grammar_modes(frontier, gate), field, wave, **gains).where("probability > 0")
        chosen = chances.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= width)
        # of equal tokens that several states await, the first spelling
        spelt = frontier.where("role IS NOT NULL").groupBy(*STATE, F.get("tokens", F.col("place")).alias("target")).agg(F.min(F.get("shown", F.col("place"))).alias("spelling"))
        ends = F.col("target") == EOS
        grown = beams.where("NOT ended").join(chosen, STATE).join(spelt, [*STATE, "target"], "left").select(
            "prompt_id",
            F.col("state").alias("before"),
            F.col("target").alias("token"),
            F.when(ends, F.col("tokens")).otherwise(F.array_append("tokens", F.col("target"))).alias("tokens"),
            F.when(ends, F.col("shown")).otherwise(F.array_append("shown", F.coalesce("spelling", "target"))).alias("shown"),
            (F.col("score") + F.log("probability")).alias("score"),
            ends.alias("ended"),
        )
        rest = beams.where("ended").select("prompt_id", F.lit(None).cast("long").alias("before"), F.lit(None).cast("string").alias("token"), "tokens", "shown", "score", "ended")
        ranked = stored(grown.unionByName(rest).withColumn("state", F.row_number().over(best).cast("long")).where(F.col("state") <= width), "ranked")
        last, beams, kept = kept, ranked.select("prompt_id", "state", "tokens", "shown", "score", "ended"), ranked
        open_ = ranked.where("NOT ended").select("prompt_id", F.col("before").alias("state"), "token", F.col("state").alias("following"))
        done = open_.isEmpty()
        if not done:
            previous, frontier = frontier, stored(stepped(frontier, open_, lanes), "frontier")
            dropped(previous)
        dropped(last)
        if done:
            break
    final = Window.partitionBy("prompt_id").orderBy(F.desc("ended"), "state")
    return beams.withColumn("rank", F.row_number().over(final)).where("rank = 1 AND size(tokens) > 0").select("prompt_id", "tokens", "shown", "score", "ended")


def role_spread(roles: DataFrame) -> DataFrame:
    """(token, energy): each role with words spreads one unit over its tokens."""
    return roles.where(F.size("tokens") > 0).select(F.explode("tokens").alias("token"), (1 / F.size("tokens")).alias("share")).groupBy("token").agg(F.sum("share").alias("energy"))


def spread_wave(spread: DataFrame) -> DataFrame:
    """(token, amplitude): energies (token, energy) as a unit wave (A10)."""
    norm = spread.agg(F.sqrt(F.sum(F.col("energy") * F.col("energy"))).alias("norm")).where("norm > 0")
    return spread.join(F.broadcast(norm)).select("token", (F.col("energy") / F.col("norm")).alias("amplitude"))


def role_wave(roles: DataFrame) -> DataFrame:
    """(token, amplitude): the unit wave of all declared roles, each of which spreads one unit over its tokens."""
    return spread_wave(role_spread(roles))


def _awaited(lanes: list[list[int]], segments: int, size: list[int], word: Callable[[int, int], str], spoken: list[str]) -> dict[str, float]:
    """What the states of one grammar await after ``spoken``, by token: the sum of what its roles spend on it."""

    def enter(segment: int) -> set:
        return {(segment, -1, 0)} if segment >= segments else {(segment, r, 0) for r in lanes[segment] if size[r]} if segment < len(lanes) else set()

    frontier = enter(0)
    for token in spoken:
        moved = {(s, r, k + 1) for s, r, k in frontier if r >= 0 and word(r, k) == token}
        frontier = {x for x in moved if x[2] < size[x[1]]}
        for segment in {s + 1 for s, r, k in moved if k >= size[r]}:
            frontier |= enter(segment)
    out: dict[str, float] = {}
    for _, r, k in sorted(frontier):
        target, value = (EOS, 1.0) if r < 0 else (word(r, k), 1 / math.sqrt(size[r]))
        out[target] = out.get(target, 0.0) + value
    return out


def own_grammars(docs: DataFrame, *, lengths: tuple[int, ...]) -> DataFrame:
    """G-2 for grammars that a row holds whole: rows (prompt_id, segments, lanes, tokens, words), where ``tokens`` are the words of each
    of the prompt's roles, ``lanes`` the places there of the roles of its first segments, more than the longest of
    ``lengths``, in order of role, and ``words`` those of its field. No row is dealt or joined.

    (prompt_id, state, target, amplitude, p): the modes after the first ``state`` words of its first role, as :func:`grammar_modes`
    has them, with the field's amplitude of the target; the roles of the first segment are the evidence. Rows without a state hold
    in ``amplitude`` the energies of tokens that the roles spread (A9), to be summed."""

    def modes(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str, float]]:
        roles, segments, lanes = batch["tokens"], batch["segments"].to_pylist(), batch["lanes"].to_pylist()
        row, inner = roles.offsets.to_numpy(), roles.values
        at, flat = inner.offsets.to_numpy(), inner.values
        for i, own in enumerate(lanes):
            if not own or not own[0]:
                continue
            starts, words = at[row[i] : row[i + 1] + 1].tolist(), {}
            size = {r: starts[r + 1] - starts[r] for lane in own for r in lane}

            def word(r: int, k: int, starts=starts, size=size, words=words) -> str:
                if r not in words:
                    words[r] = flat.slice(starts[r], min(size[r], max(lengths) + 1)).to_pylist()
                return words[r][k]

            gate = sum(size[r] > 0 for r in own[0]) / len(own[0])
            if gate <= LEAST_ENERGY:
                continue
            for state in lengths:
                first = own[0][0]
                summed = _awaited(own, segments[i], size, word, [word(first, k) for k in range(min(state, size[first]))])
                energy = sum(v * v for v in summed.values())
                for target, value in summed.items():
                    yield i, state, target, value * math.sqrt(gate / energy)

    def heard(words: pa.Array, rows: np.ndarray, targets: pa.Array) -> np.ndarray:
        """The unit amplitude of each of ``targets`` among the words of its row."""
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
        coded = words.flatten().dictionary_encode()
        width = max(1, len(coded.dictionary))
        keys, n = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
        norm = np.sqrt(np.bincount(keys // width, (n * n).astype(float), len(words)))
        code = pc.fill_null(pc.index_in(targets, coded.dictionary), -1).to_numpy()
        wanted = rows * width + code
        place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        known = (code >= 0) & (keys[place] == wanted) if len(keys) else np.zeros(len(rows), bool)
        out = np.zeros(len(rows))
        out[known] = n[place[known]] / norm[rows[known]]
        return out

    def spread(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        coded = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
        return coded.dictionary, np.bincount(coded.indices.to_numpy(), np.concatenate([p[1] for p in parts]), len(coded.dictionary))

    def told(parts: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens, energy = spread(parts)
        for i in range(0, len(tokens), ROWS):
            some = tokens.slice(i, ROWS)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), some, pa.array(energy[i : i + ROWS]), pa.nulls(len(some), pa.float64())], names=NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            inner = batch["tokens"].flatten()
            size = pc.list_value_length(inner).to_numpy()
            if len(flat := inner.flatten()):
                parts.append(spread([(flat, np.repeat(1 / np.maximum(size, 1), size))]))
                held += len(parts[-1][0])
            if held > HELD:
                parts = [spread(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield from told(parts)
                    parts, held = [], 0
            if found := list(modes(batch)):
                i, state, target, amplitude = zip(*found, strict=True)
                rows, targets = np.array(i), pa.array(target, pa.string())
                out = pa.RecordBatch.from_arrays([batch["prompt_id"].take(pa.array(rows)), pa.array(state, pa.int64()), targets, pa.array(amplitude), pa.array(heard(batch["words"], rows, targets))], names=NAMES)
                yield from (out.slice(k, ROWS) for k in range(0, len(out), ROWS))
        if parts:
            yield from told(parts)

    return docs.select("prompt_id", "segments", "lanes", "tokens", "words").mapInArrow(work, "prompt_id long, state long, target string, amplitude double, p double")


def encoded(roles: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Roles (prompt_id, role, words, origin) as (prompt_id, role, tokens, shown, origin): words of the vocabulary (column token)
    are one symbol each; of others every UTF-8 byte is one, and between two such words stands the byte of a blank."""
    words = roles.select("prompt_id", "role", "origin", F.posexplode_outer("words").alias("place", "word")).withColumn("token", X.folded(F.col("word")))
    known = words.join(vocabulary.select("token", F.lit(True).alias("known")).distinct(), "token", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    gathered = known.groupBy("prompt_id", "role", "origin").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "known", "token", "word")))).alias("w"))
    bytes_ = lambda w: F.transform(X.byte_tokens(w), lambda b: F.struct(b.alias("token"), b.alias("shown")))
    blank = F.array(F.struct(F.lit("<byte:20>").alias("token"), F.lit("<byte:20>").alias("shown")))
    empty = F.array().cast("array<struct<token: string, shown: string>>")
    parts = lambda ws: F.flatten(F.transform(ws, lambda x, i: F.when(x["known"], F.array(F.struct(x["token"].alias("token"), x["word"].alias("shown")))).otherwise(F.concat(F.when((i > 0) & ~F.coalesce(F.get(ws, i - 1)["known"], F.lit(True)), blank).otherwise(empty), bytes_(x["word"])))))
    spelled = gathered.withColumn("s", X.bound(F.col("w"), parts))
    return spelled.select("prompt_id", "role", F.transform("s", lambda x: x["token"]).alias("tokens"), F.transform("s", lambda x: x["shown"]).alias("shown"), "origin")
