"""Causal rolling counts and distinct counts, as running sums of deltas.

A window of ``W`` ms for the attempt at ``(t, id)`` holds the attempts of the same entity that come
before it in ``(t, id)`` order and happened after ``t - W``. Spark re-aggregates a sliding frame for
every row, which costs rows x window depth. Here every attempt instead contributes

* ``+1`` at its own place in the order, and
* ``-1`` at ``t + W``, ahead of the attempts of that millisecond,

so a window value is the sum of everything earlier: one running sum, whatever the depth. Failures
add the same way. For a distinct count, a value counts once while its occurrences overlap: an
occurrence adds 1 only if the previous one of the same (entity, value) is at least ``W`` old, and
takes 1 away at ``t + W`` only if the next one is at least ``W`` later. Those two gaps need only
``lag``/``lead`` over the (entity, value) pair.

Four shuffles serve all families together: pairs, their gaps back to one row per attempt, deltas, and back to one row per attempt. What
the first two lead to is written down, one narrow row per attempt, so their files are gone when the others begin. Tokens travel as the
sixteen bytes they name, and a gap as the windows that it spans.
Entities missing from an attempt (null tokens) produce no rows, so nulls never form a hot group.

**Hot entities.** One entity may hold a third of all rows. A deterministic sample finds entities
above a share of the data; only theirs are cut into short time slices, each its own group. What
slices miss from each other is added back from a tree of totals: slices, blocks of slices, the entity's blocks.
Slicing changes the layout, never the result.

Expressions are written as SQL text: the plan is wide, and one parsed string per column builds far
faster than a tree of Python calls.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardweir.functions.scalars import TOKEN_PREFIXES
from cardweir.session import materialise



@dataclass(frozen=True)
class Family:
    """Windows (seconds) kept for one entity column and the columns counted distinct in them."""

    name: str
    key: str
    windows: tuple[int, ...]
    distinct: tuple[tuple[str, str], ...] = ()  # (plural used in the output name, column)
    failures: bool = True
    last_seen: bool = False


@dataclass(frozen=True)
class Slicing:
    """How hot entities are found and cut. ``share`` bounds the list that is broadcast.

    Slices of ``slice_ms`` are the leaves of a tree of totals: ``fan`` neighbouring slices make a block, and an entity is its
    blocks. One task holds the slices of a block or the blocks of an entity, never all slices of an entity.

    At most ``families / share`` entities can exceed the share, whatever the data size: with the
    default, 10,000 per family, about 5 MB in all.
    """

    share: float = 1e-4
    minimum_rows: int = 250_000
    sample_modulus: int = 64
    slice_ms: int = 10_000
    fan: int = 4_096


@dataclass(frozen=True)
class RollingSpec:
    families: tuple[Family, ...]
    event_id: str = "event_id"
    time_ms: str = "occurred_at_ms"
    failed: str = "outcome = 'failed'"
    carry: tuple[str, ...] = field(default=())  # numeric columns returned beside the windows
    slicing: Slicing | None = Slicing()


# Entity families, their windows and relations.
MERCHANT = Family(
    "merchant", "merchant_id", (60, 300, 3600),
    (("instruments", "payment_instrument_token"), ("devices", "device_token"), ("networks", "network_token")),
)
DEVICE = Family(
    "device", "device_token", (60, 300, 3600),
    (("instruments", "payment_instrument_token"), ("sessions", "session_token")),
)
NETWORK = Family(
    "network", "network_token", (60, 300, 3600),
    (("instruments", "payment_instrument_token"), ("devices", "device_token"), ("sessions", "session_token")),
)
INSTRUMENT = Family(
    "instrument", "payment_instrument_token", (300, 3600),
    (("devices", "device_token"), ("networks", "network_token"), ("merchants", "merchant_id")),
)
SESSION = Family(
    "session", "session_token", (60, 300), (("instruments", "payment_instrument_token"),)
)
CHECKOUT = Family("checkout", "checkout_id", (3600,), failures=False, last_seen=True)
FAMILIES = (MERCHANT, DEVICE, NETWORK, INSTRUMENT, SESSION, CHECKOUT)


def _entity_columns(spec: RollingSpec) -> list[str]:
    seen: list[str] = []
    for family in spec.families:
        for column in (family.key, *[c for _, c in family.distinct]):
            if column not in seen:
                seen.append(column)
    return seen


def _pairs(spec: RollingSpec) -> list[tuple[str, str]]:
    """Unordered column pairs whose gaps are needed; (c, c) stands for the entity alone."""
    pairs: list[tuple[str, str]] = []
    for family in spec.families:
        wanted = [tuple(sorted((family.key, c))) for _, c in family.distinct]
        if family.last_seen:
            wanted.append((family.key, family.key))
        for pair in wanted:
            if pair not in pairs:
                pairs.append(pair)
    return pairs


#: Rows that one task sorts, of any of the three shuffles. Partitions follow the number of attempts, so what a task holds does not.
ROWS_PER_TASK = 500_000
#: Parts of such a task in the shuffle by entity: entities just below the sliced ones are as large as a task, and several of them meet
#: in one by chance. In finer partitions a task holds little beside its largest entity.
ENTITY_PARTS = 4


def _partitions(df: DataFrame, attempts: int, rows_each: int) -> int:
    """Partitions for ``rows_each`` rows of each attempt; a small table takes as many as its session gives any shuffle, at most."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-attempts * rows_each // ROWS_PER_TASK)
    return needed if needed > usual else max(1, min(usual, needed * 4))


#: Most partitions of a shuffle whose rows Spark writes as they come; for more, a task gathers its rows in memory to sort them.
UNSORTED_PARTITIONS = 200


def _dealt(df: DataFrame, attempts: int, rows_each: int, event_id: str) -> DataFrame:
    """Attempts in as many tasks as the ``rows_each`` rows of each need, before they are made. The splits of a file follow its bytes, and the
    shuffle after this gathers all that a task makes of its split."""
    needed = -(-attempts * rows_each // ROWS_PER_TASK)
    tasks = max(min(needed, UNSORTED_PARTITIONS), needed // 8)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, event_id)


def _structs(rows: list[str]) -> str:
    return f"inline(array({', '.join(f'named_struct({r})' for r in rows)}))"


def _is_token(column: str, prefix: str) -> str:
    """True for a text of the shape ``prefix_<32 hexadecimal digits>``, false for any other, null for null; several times faster than a pattern."""
    digits = f"substr({column}, 5)"
    shape = f"octet_length({column}) = 36 and startswith({column}, '{prefix}_') and lower(hex(unhex({digits}))) = {digits}"
    return f"if({column} is null, null, coalesce({shape}, false))"


def _bytes_of(column: str) -> str:
    """A token as the sixteen bytes that it names; any other text as its own bytes and one or two more, which never are sixteen. They
    are kept as a string, which Spark compares without a copy."""
    return (
        f"cast(if({_is_token(column, TOKEN_PREFIXES[column])}, unhex(substr({column}, 5)),"
        f" concat(cast({column} as binary), unhex(if(octet_length({column}) = 15, '0001', '00')))) as string)"
    )


def _narrow(df: DataFrame, spec: RollingSpec) -> tuple[DataFrame, int, str]:
    """Attempts with what the windows need, as few bytes as they can be told by; how many there are; the text of an id as it is then.

    Windows order by id, and bytes of tokens do as the tokens do. One id of another shape among them leaves all ids as they are.
    """
    kinds, columns = dict(df.dtypes), _entity_columns(spec)
    prefix = TOKEN_PREFIXES.get(spec.event_id) if kinds[spec.event_id] == "string" else None
    shaped = _is_token(spec.event_id, prefix) if prefix else "false"
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"coalesce(bool_and({shaped}), false)").alias("shaped")).first()
    own_id = f"cast(unhex(substr({spec.event_id}, 5)) as string) as {spec.event_id}" if seen.shaped else spec.event_id
    packed = all(c in TOKEN_PREFIXES and kinds[c] == "string" for c in columns)
    rows = df.selectExpr(
        own_id, spec.time_ms, f"int({spec.failed}) as failed", *[f"{_bytes_of(c)} as {c}" if packed else c for c in columns], *spec.carry
    )
    return rows, seen.n, f"concat('{prefix}_', lower(hex(id)))" if seen.shaped else "id"


def hot_entities(df: DataFrame, spec: RollingSpec) -> DataFrame:
    """(ent, key) of every entity above the share, judged on a deterministic sample of attempts.

    The sample only decides the layout. It is a hash of the attempt id, so every evaluation of the
    plan sees the same entities.
    """
    s = spec.slicing
    columns = _entity_columns(spec)
    sample = df.filter(f"pmod(xxhash64({spec.event_id}), {s.sample_modulus}) = 0")
    total = sample.agg(F.count(F.lit(1)).alias("n")).scalar()
    melted = sample.selectExpr(
        _structs([f"'ent', {i}Y, 'key', {c}" for i, c in enumerate(columns)])
    ).filter("key is not null")
    least = F.greatest(F.lit(s.minimum_rows / s.sample_modulus), total * F.lit(s.share))
    return (
        melted.groupBy("ent", "key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= least)
        .selectExpr("ent", "key", "true as _hot")
    )


def _flag(df: DataFrame, hot: DataFrame, ent: str, key: str, flag: str) -> DataFrame:
    side = hot.selectExpr(f"ent as {flag}_ent", f"key as {flag}_key", f"_hot as {flag}")
    return df.join(
        F.broadcast(side),
        (F.col(ent) == F.col(f"{flag}_ent")) & (F.col(key) == F.col(f"{flag}_key")),
        "left",
    ).drop(f"{flag}_ent", f"{flag}_key")


def _with_blocks(slices: DataFrame, keys: list[str], slicing: Slicing, sums: list, ahead: list, within: list) -> DataFrame:
    """Slices with what their block's neighbours give (``ahead``, over an entity's blocks) and their own (``within``, over a block's slices)."""
    slices = slices.withColumn("block", F.expr(f"slice div {slicing.slice_ms * slicing.fan}"))
    order = W.partitionBy(*keys).orderBy("block")
    blocks = slices.groupBy(*keys, "block").agg(*sums).select(*keys, "block", *[c(order) for c in ahead])
    named = blocks.select(*[F.col(c).alias(f"y_{c}") for c in (*keys, "block")], *blocks.columns[len(keys) + 1 :])
    inside = W.partitionBy(*keys, "block").orderBy("slice")
    own = slices.select(*keys, "block", "slice", *[c(inside) for c in within])
    same = F.col("block") == F.col("y_block")
    for c in keys:
        same &= F.col(c) == F.col(f"y_{c}")
    return own.join(named, same).drop(*[f"y_{c}" for c in (*keys, "block")], "block")


def _slice_carries(totals: DataFrame, keys: list[str], names: list[str], slicing: Slicing) -> DataFrame:
    """``in_<name>`` of each slice: the total of all slices of its entity before it."""
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    placed = _with_blocks(
        totals, keys, slicing,
        sums=[F.sum(n).alias(n) for n in names],
        ahead=[lambda w, n=n: F.coalesce(F.sum(n).over(before(w)), F.lit(0)).alias(f"_b_{n}") for n in names],
        within=[lambda w, n=n: F.coalesce(F.sum(n).over(before(w)), F.lit(0)).alias(f"_s_{n}") for n in names],
    )
    return placed.select(*keys, "slice", *[(F.col(f"_b_{n}") + F.col(f"_s_{n}")).alias(f"in_{n}") for n in names])


def _slice_edges(edges: DataFrame, keys: list[str], slicing: Slicing) -> DataFrame:
    """``before_t`` and ``after_t`` of each slice: the time of the row just before it and just after it in its pair's order."""
    placed = _with_blocks(
        edges, keys, slicing,
        sums=[F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t")],
        ahead=[lambda w: F.lag("last_t").over(w).alias("_b_before"), lambda w: F.lead("first_t").over(w).alias("_b_after")],
        within=[lambda w: F.lag("last_t").over(w).alias("_s_before"), lambda w: F.lead("first_t").over(w).alias("_s_after")],
    )
    return placed.selectExpr(*keys, "slice", "coalesce(_s_before, _b_before) as before_t", "coalesce(_s_after, _b_after) as after_t")


def _pair_gaps(df: DataFrame, spec: RollingSpec, hot: DataFrame | None, attempts: int) -> DataFrame:
    """One row per attempt: for each pair, the steps (``_step``) of the ms since its previous and until its next occurrence, several pairs to
    a long (``_gap_bits``), and for pairs of one column the ms since the previous."""
    pairs, columns = _pairs(spec), _entity_columns(spec)
    rows = df.selectExpr(
        f"{spec.event_id} as id",
        f"{spec.time_ms} as t",
        _structs([
            f"'pair', {i}Y, 'a_ent', {columns.index(a)}Y, 'b_ent', {columns.index(b)}Y, "
            f"'a', {a}, 'b', {b if b != a else repr('')}"
            for i, (a, b) in enumerate(pairs)
        ]),
    ).filter("a is not null and b is not null")
    group = ["pair", "a", "b"]
    if hot is not None:
        rows = _flag(_flag(rows, hot, "a_ent", "a", "a_hot"), hot, "b_ent", "b", "b_hot")
        width = spec.slicing.slice_ms
        rows = rows.withColumn(
            "slice",
            F.expr(f"if(a_hot and (b_hot or a_ent = b_ent), t div {width} * {width}, null)"),
        )
        group.append("slice")
    rows = rows.select("id", "t", *group).repartition(_partitions(df, attempts, len(pairs)), *group)
    # The hash leads the sort: its eight bytes tell most groups apart without comparing tokens.
    rows = rows.withColumn("kh", F.xxhash64("pair", "a", "b"))
    order = W.partitionBy("kh", *group).orderBy("t", "id")
    rows = rows.select(
        "id", "t", *group, F.lag("t").over(order).alias("prev_t"), F.lead("t").over(order).alias("next_t")
    )
    if hot is not None:
        edges = (
            rows.filter("slice is not null")
            .groupBy("pair", "a", "b", "slice")
            .agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
        )
        # equal names in the order of the shuffle: the rows stay where they are
        rows = rows.join(_slice_edges(edges, ["pair", "a", "b"], spec.slicing), group, "left"
        ).selectExpr(
            "id", "t", "pair",
            "coalesce(prev_t, before_t) as prev_t", "coalesce(next_t, after_t) as next_t",
        )
    # Shuffle the narrow rows, not the wide partial aggregates they would become. A pair that stands alone has nothing to tell.
    alone = [i for i, (a, b) in enumerate(pairs) if a == b]
    exact = f"if(pair in ({', '.join(f'{i}Y' for i in alone)}), t - prev_t, null)" if alone else "bigint(null)"
    size = 2 * _step_bits(spec)
    code = f"({_step(spec, 't - prev_t')}) + ({_step(spec, 'next_t - t')}) * {1 << size // 2}"
    rows = rows.filter("prev_t is not null or next_t is not null").selectExpr(
        "id", f"pair * {1 << size} + {code} as gap", *([f"{exact} as back"] if alone else [])
    ).repartition(_partitions(df, attempts, len(pairs)), "id")
    fit = _pairs_fit(spec)
    return rows.groupBy("id").agg(*[
        # an id on several rows counts with its widest gaps: what is set in any of them
        F.expr(f"bit_or(if(gap div {fit << size} = {w}, shiftleft(bigint(gap & {(1 << size) - 1}), {size} * ((gap div {1 << size}) % {fit})), 0L)) as gaps_{w}")
        for w in range(-(-len(pairs) // fit))
    ], *[F.expr(f"max(if(gap div {1 << size} = {i}, back, null)) as age_{i}") for i in alone])


def _windows(spec: RollingSpec) -> list[int]:
    return sorted({w for f in spec.families for w in f.windows})


def _step_bits(spec: RollingSpec) -> int:
    return 1 + len(_windows(spec))


def _step(spec: RollingSpec, gap: str) -> str:
    """0 for no gap; else the lowest bit, and one more for each window that is no longer than the gap. The wider of two has all bits of both."""
    return f"if({gap} is null, 0, 1 + {' + '.join(f'if({gap} >= {w * 1000}, {2 << i}, 0)' for i, w in enumerate(_windows(spec)))})"


def _pairs_fit(spec: RollingSpec) -> int:
    """Pairs whose steps, both ways, fit into one long."""
    return 62 // (2 * _step_bits(spec))


def _gap_bits(spec: RollingSpec, pair: int, side: str) -> tuple[str, int]:
    """The long and its bit where the step of a pair's gap begins."""
    bits, fit = _step_bits(spec), _pairs_fit(spec)
    return f"coalesce(gaps_{pair // fit}, 0L)", pair % fit * 2 * bits + (bits if side == "ahead" else 0)


ARRIVAL = 9  # sorts after the expiries (window positions 0..2) of the same millisecond
UNSPLIT = 10  # a cold entity's row: still to be turned into its arrival and expiries
SLOTS = 3  # windows a family may have


def _run_mask(spec: RollingSpec, family: Family, side: str) -> str:
    """Bit ``relation * SLOTS + window``: the run of that value starts (or ends) at this attempt."""
    pairs = _pairs(spec)
    bits = []
    for r, (_, column) in enumerate(family.distinct):
        gaps, at = _gap_bits(spec, pairs.index(tuple(sorted((family.key, column)))), side)
        for w, seconds in enumerate(family.windows):
            bits.append(
                f"if({column} is not null and ({gaps} & {1 << at}L = 0 or {gaps} & {2 << at + _windows(spec).index(seconds)}L <> 0),"
                f" {1 << (r * SLOTS + w)}, 0)"
            )
    return " | ".join(bits) if bits else "0"


def _kinds(spec: RollingSpec) -> str:
    """Arrival plus one expiry per window, for the family of the row."""
    arms = " ".join(
        f"when {f}Y then array({ARRIVAL}Y, {', '.join(f'{w}Y' for w in range(len(fam.windows)))})"
        for f, fam in enumerate(spec.families)
    )
    return f"case fam {arms} end"


def _place(spec: RollingSpec) -> str:
    """Time of the row in its entity's order: the attempt itself or the end of a window."""
    arms = " ".join(
        f"when fam = {f}Y and kind = {w}Y then t + {seconds * 1000}"
        for f, fam in enumerate(spec.families)
        for w, seconds in enumerate(fam.windows)
    )
    return f"case when kind = {ARRIVAL}Y then t {arms} end"


def _measures(spec: RollingSpec) -> dict[str, str]:
    """Delta per slot: attempts n, failures f and distinct values d, one each per window."""
    out: dict[str, str] = {}
    for w in range(max(len(f.windows) for f in spec.families)):
        sign = f"case kind when {ARRIVAL}Y then 1L when {w}Y then -1L else 0L end"
        out[f"n{w}"] = sign
        if any(f.failures for f in spec.families):
            out[f"f{w}"] = f"({sign}) * failed"
        for r in range(max(len(f.distinct) for f in spec.families)):
            bit = r * SLOTS + w
            out[f"d{r}_{w}"] = (
                f"case kind when {ARRIVAL}Y then bigint(shiftright(int(starts), {bit}) & 1)"
                f" when {w}Y then -bigint(shiftright(int(ends), {bit}) & 1) else 0L end"
            )
    return out


def _arriving(column: str) -> Column:
    """The column in the rows of arrivals, split or not; null in the ends of windows."""
    return F.when(F.col("kind") >= ARRIVAL, F.col(column)).alias(column)


def _packed(measures: dict[str, str]) -> dict[str, str]:
    """Two deltas in one long, the second 2**32 times its worth: rows are sorted with their deltas, half as many columns this way. A sum
    splits again as no window holds 2**31 attempts of an entity."""
    names = list(measures)
    return {
        f"s{i // 2}": " + ".join(f"({measures[n]})" + (f" * {1 << 32}L" if j else "") for j, n in enumerate(names[i : i + 2]))
        for i in range(0, len(names), 2)
    }


def _unpacked(measures: dict[str, str], name: str) -> str:
    """The sum of one delta from that of its pair, with its sign."""
    i = list(measures).index(name)
    low = f"shiftright(shiftleft(s{i // 2}, 32), 32)"
    return f"shiftright(s{i // 2} - {low}, 32)" if i % 2 else low


def rolling_features(df: DataFrame, spec: RollingSpec) -> DataFrame:
    """``event_id``, ``occurred_at_ms``, the carried columns and every window column of ``spec``."""
    columns, pairs = _entity_columns(spec), _pairs(spec)
    df, attempts, id_text = _narrow(df, spec)
    hot = None
    if spec.slicing is not None:
        # Written once, since three joins and their slice totals must all see the same list. With
        # no hot entity the plan has no slices at all.
        hot = materialise(hot_entities(df, spec), "hot-entities")
        hot = None if hot.isEmpty() else hot
    carry, taken = list(spec.carry), ["taken"] if spec.carry else []

    base = df.selectExpr(f"{spec.event_id} as id", f"{spec.time_ms} as t", "failed", *columns, *carry)
    steps = sum(1 + len(f.windows) for f in spec.families)
    # masks and age of each family, from the gaps of its pairs
    parts = []
    for f, family in enumerate(spec.families):
        age = f"age_{pairs.index((family.key, family.key))}" if family.last_seen else "bigint(null)"
        parts.append((f"smallint({_run_mask(spec, family, 'back')})", f"smallint({_run_mask(spec, family, 'ahead')})", age))
    if pairs:
        base = base.join(_pair_gaps(_dealt(df, attempts, len(pairs), spec.event_id), spec, hot, attempts), "id", "left")
        base = materialise(
            base.selectExpr(
                "id", "t", "failed", *dict.fromkeys(f.key for f in spec.families), *carry,
                *[f"{e} as {n}_{f}" for f, part in enumerate(parts) for n, e in zip(("starts", "ends", "age_of"), part)],
            ),
            "attempt-runs",
        )
        parts = [(f"starts_{f}", f"ends_{f}", f"age_of_{f}") for f in range(len(parts))]
    dealt = _dealt(base, attempts, steps, "id")

    # One row per family; an attempt's first family with a key takes the carried columns along.
    entries = [
        f"'fam', {f}Y, 'ent', {columns.index(family.key)}Y, 'key', {family.key}, 'starts', {starts}, 'ends', {ends}, 'age', {age}"
        for f, (family, (starts, ends, age)) in enumerate(zip(spec.families, parts))
    ]
    keys = [family.key for family in spec.families]
    first = "coalesce(" + ", ".join(f"if({k} is not null, {f}Y, null)" for f, k in enumerate(keys)) + ") as first_fam"
    deltas = dealt.selectExpr("id", "t", "failed", *carry, first, _structs(entries)).filter("key is not null")
    if carry:  # one slot in the rows that go without
        deltas = deltas.withColumn("taken", F.expr(f"if(fam = first_fam, struct({', '.join(carry)}), null)")).drop(*carry)

    group = ["fam", "key"]
    if hot is not None:
        # Rows of hot entities are placed in their slices before the shuffle; the others become
        # arrival and expiries after it, which shuffles a third of the rows.
        width = spec.slicing.slice_ms
        deltas = (
            _flag(deltas, hot, "ent", "key", "hot")
            .withColumn(
                "kind", F.explode(F.expr(f"if(hot, {_kinds(spec)}, array({UNSPLIT}Y))"))
            )
            .withColumn(
                "slice", F.expr(f"if(hot, ({_place(spec)}) div {width} * {width}, null)")
            )
        )
        group.append("slice")
    else:
        deltas = deltas.withColumn("kind", F.lit(UNSPLIT).cast("tinyint"))
    deltas = (
        # the end of a window is only summed: what names the attempt stays with its arrival
        deltas.select(*group, "t", "kind", "failed", "starts", "ends", *[_arriving(c) for c in ("id", "age", *taken)])
        .repartition(_partitions(df, attempts, steps * ENTITY_PARTS), *group)
        .withColumn("kind", F.explode(F.expr(f"if(kind = {UNSPLIT}Y, {_kinds(spec)}, array(kind))")))
        .withColumn("t", F.expr(_place(spec)))
    )

    measures = _packed(_measures(spec))
    names = list(measures)
    deltas = deltas.select(
        F.expr("xxhash64(fam, key) as kh"), *group, "t", "kind", *[_arriving(c) for c in ("id", "age", *taken)],
        *[F.expr(f"{e} as {n}") for n, e in measures.items()],
    )
    before = W.partitionBy("kh", *group).orderBy("t", "kind", "id").rowsBetween(W.unboundedPreceding, -1)
    running = deltas.select(
        *group, "t", "kind", "id", "age", *taken,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names],
    ).filter(f"kind = {ARRIVAL}Y")
    if hot is not None:
        totals = (
            deltas.filter("slice is not null")
            .groupBy("fam", "key", "slice")
            .agg(*[F.sum(n).alias(n) for n in names])
        )
        carried_in = _slice_carries(totals, ["fam", "key"], names, spec.slicing)
        running = running.join(carried_in, group, "left").selectExpr(
            "fam", "id", "t", "age", *taken, *[f"{n} + coalesce(in_{n}, 0) as {n}" for n in names]
        )

    running = running.select("id", "fam", "t", "age", *taken, *names).repartition(_partitions(df, attempts, len(spec.families)), "id")
    outputs, derived = [], []
    for f, family in enumerate(spec.families):
        slots: dict[str, str] = {}
        for w, seconds in enumerate(family.windows):
            slots[f"{family.name}_prior_attempt_count_{seconds}s"] = f"n{w}"
            if family.failures:
                slots[f"{family.name}_prior_failure_count_{seconds}s"] = f"f{w}"
            for r, (plural, _) in enumerate(family.distinct):
                slots[f"{family.name}_distinct_{plural}_{seconds}s"] = f"d{r}_{w}"
        slots = {name: _unpacked(_measures(spec), slot) for name, slot in slots.items()}
        for name, slot in slots.items():
            outputs.append(f"coalesce(max(if(fam = {f}Y, {slot}, null)), 0L) as {name}")
        if family.failures and 300 in family.windows:
            attempts = f"{family.name}_prior_attempt_count_300s"
            failures = f"{family.name}_prior_failure_count_300s"
            derived.append(
                f"if({attempts} = 0, 0L, {failures} * 10000 div {attempts})"
                f" as {family.name}_prior_failure_rate_300s_bp"
            )
        if family.last_seen:
            horizon = family.windows[-1]
            outputs.append(
                f"coalesce(max(if(fam = {f}Y and age < {horizon * 1000}, age, null)), 0L)"
                f" as {family.name}_previous_attempt_age_ms"
            )
            derived.append(
                f"if({family.name}_prior_attempt_count_{horizon}s > 0, 1L, 0L)"
                f" as {family.name}_history_present"
            )
    result = running.groupBy("id").agg(
        F.expr(f"max(t) as {spec.time_ms}"),
        *[F.expr(f"max(taken.{c}) as {c}") for c in carry],
        *[F.expr(e) for e in outputs],
    )
    # An attempt without any of the keys has no history.
    names = [e.rsplit(" as ", 1)[1] for e in outputs]
    alone = base.filter(" and ".join(f"{k} is null" for k in dict.fromkeys(keys))).selectExpr(
        "id", f"t as {spec.time_ms}", *carry, *[f"0L as {n}" for n in names]
    )
    result = result.unionByName(alone)
    return result.selectExpr(f"{id_text} as {spec.event_id}", *[c for c in result.columns if c != "id"], *derived)
