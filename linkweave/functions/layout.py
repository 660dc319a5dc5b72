"""Numbers of the force layout as SQL expressions over named columns, shared by ticks and queries."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Tunables of the layout; the defaults are fixed values."""

    charge_base: float = 115.0
    charge_importance: float = 126.0
    charge_distance: float = 480.0
    link_rest: float = 48.0
    link_extension: float = 1024.0
    link_cube: float = 150000.0
    link_linear: float = 0.16
    link_cap: float = 192.0
    node_cap: float = 1024.0
    hub_pull: float = 3.0
    hub_reaction: float = 0.02
    unrelated: float = 40.0
    unrelated_cap: float = 14.0
    unrelated_budget: int = 220_000  # 0: all pairs in the near reach, whatever their number
    boundary_density: float = 160.0
    boundary_strength: float = 0.12
    boundary_return: float = 0.6
    collide_padding: float = 18.0
    collide_iterations: int = 2
    center: float = 0.035
    velocity_decay: float = 0.4
    decay_mode: str = "keep"  # keep 1 - decay of the velocity; "multiply" keeps decay
    travel: float = 18.0
    alpha: float = 0.8
    alpha_min: float = 0.001
    alpha_target: float = 0.0
    ticks: int = 1800

    @property
    def alpha_decay(self) -> float:
        return 1 - (self.alpha_min / self.alpha) ** (1 / self.ticks)

    @property
    def kept_velocity(self) -> float:
        return 1 - self.velocity_decay if self.decay_mode == "keep" else self.velocity_decay

    def merged(self, over: dict) -> Settings:
        """These settings overlaid by those of a JSON object; unknown names are passed over."""
        from dataclasses import fields, replace

        return replace(self, **{f.name: type(getattr(self, f.name))(over[f.name]) for f in fields(self) if f.name in over})


def cooled(n: str, s: Settings = Settings()) -> str:
    """Alpha after n ticks (K12): each goes the same share of the way to its target."""
    return f"{s.alpha_target!r} + {s.alpha - s.alpha_target!r} * pow({1 - s.alpha_decay!r}, {n})"


def spacing(n: str) -> str:
    return f"least(2.5, greatest(1.0, pow({n} / 250.0, 0.25)))"


def boundary_radius(n: str, three: bool = False) -> str:
    return f"220.0 * cbrt(3.0 * {n} / (4.0 * pi()))" if three else f"160.0 * sqrt({n} / pi())"


def importance(size: str, degree: str) -> str:
    return f"least(1.0, ln(1 + {size}) / ln(1 + 2000000.0)) * 0.45 + sqrt(least({degree}, 56) / 56.0) * 0.55"


def node_radius(id_: str, imp: str) -> str:
    return f"CASE WHEN length({id_}) > 18 THEN 5.0 ELSE 6.0 END + 6.0 * ({imp})"


def hub_score(is_hub: str, degree: str, top: str) -> str:
    return f"CASE WHEN {is_hub} THEN 0.8 + 0.2 * ln(1.0 + {degree}) / greatest(ln(1.0 + {top}), 0.000001) ELSE 0.0 END"


def link_distance(ms: str) -> str:
    """Ease-out from 150000 to 10 over 30 seconds."""
    return f"round(10 + 149990 * pow(1 - least(1.0, greatest(0.0, {ms} / 30000.0)), 3))"


def collision_strength(decay: str) -> str:
    return f"1.0 / greatest(0.25, 1.0 - least(0.9, greatest(0.0, {decay})))"


def repulsion(pairs: str, n: str) -> str:
    return f"CASE WHEN {n} < 2 THEN 1.0 ELSE least(3.0, sqrt(greatest(1.0, 2.0 * {pairs} / {n} / 6.0))) END"


def spring(d: str, s: Settings = Settings()) -> str:
    """Pull of a link at distance d, before weight and alpha (K3)."""
    e = f"least({s.link_extension}, greatest(0.0, {d} - {s.link_rest}))"
    return f"least({s.link_cap}, pow({e}, 3) / {s.link_cube} + {s.link_linear} * {e})"


def boundary_pull(d: str, radius: str, s: Settings = Settings()) -> str:
    """Inward pull at distance d from the centre (K9); 0 inside."""
    band = f"least(120.0, greatest(1.0, 0.08 * ({radius})))"
    x = f"greatest(0.0, {d} - ({radius}))"
    return f"least({s.boundary_strength} * {band} * (exp(least(50.0, {x} / {band})) - 1.0), {s.boundary_return} * {x})"


def slider_position(v: str, low: float, knee: float, top: float) -> str:
    """Two logarithmic halves, low to knee and knee to top, on 0 to 1."""
    return f"CASE WHEN {v} <= {knee} THEN greatest(0.0, least(0.5, 0.5 * ln(greatest({low}, {v}) / {low}) / ln({knee} / {low}))) ELSE greatest(0.5, least(1.0, 0.5 + 0.5 * ln(least({top}, {v}) / {knee}) / ln({top} / {knee}))) END"


def slider_value(p: str, low: float, knee: float, top: float, step: float = 1.0) -> str:
    """The value at a place of the slider, in whole steps."""
    at = f"greatest(0.0, least(1.0, {p}))"
    raw = f"CASE WHEN {at} <= 0.5 THEN {low} * exp({at} / 0.5 * ln({knee} / {low})) ELSE {knee} * exp(({at} - 0.5) / 0.5 * ln({top} / {knee})) END"
    return f"greatest({low}, least({top}, floor(({raw}) / {step} + 0.5) * {step}))"


def jiggle(a: str, b: str, axis: int = 0) -> str:
    """Offset within half a millionth for a coincident pair, from an integer hash; the other way round it has the other sign."""
    # factors are taken modulo 2^32 first and halves are multiplied apart, so that no product leaves 64 bits
    part = lambda v, m: f"((({v}) & 65535) * {m} + ((((({v}) >> 16) & 65535) * {m} & 65535) << 16))"
    h = f"(({part(f'least({a}, {b})', 1664525)} + {part(f'greatest({a}, {b})', 1013904223)} + {axis * 2246822519}) & 4294967295)"
    low = f"(({h} & 65535) + ({h} >> 16) - 2 * ({h} & ({h} >> 16) & 65535))"  # exclusive or
    # written with exponents: decimals of whole numbers would be rounded to nothing
    return f"(CASE WHEN {a} < {b} THEN 1 ELSE -1 END * ({low} / 65535e0 - 5e-1) * 1e-6)"


def finite(x: str, default: str = "0.0") -> str:
    """x, or the default where it is null, NaN or infinite."""
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) = CAST('Infinity' AS DOUBLE) THEN {default} ELSE {x} END"


def f32(x: str) -> str:
    """x as a 32-bit float, what is not finite as 0."""
    return f"CAST(CAST({finite(x)} AS FLOAT) AS DOUBLE)"


def export_radius(radius: str, scale: str = "1.0", padding: float = 18.0) -> str:
    """Drawn radius: scaled, but at most 0.35 of the padding over the layout's."""
    return f"least(({radius}) * ({scale}), ({radius}) + {max(0.0, padding) * 0.35!r})"


def visual_scale(visible: str, total: str, zoom: str, hubs: str) -> str:
    """Boost of dots in sparse overviews; 1 for whole graphs and when zoomed in."""
    unit = lambda x: f"greatest(0.0, least(1.0, {x}))"
    hidden = unit(f"1.0 - {visible} / ({total} * 1.0)")
    shown = unit(f"({visible} - {hubs}) / (greatest(1, {total} - {hubs}) * 1.0)")
    fade = f"(exp(-8.0 * {shown}) - exp(-8.0)) / (1.0 - exp(-8.0))"
    normal = f"CASE WHEN {total} > 1000 AND {hubs} > 0 THEN 1.0 - exp(-greatest(0.0, {visible} - {hubs} * 1.0) / greatest(1.0, {hubs} * 0.05)) ELSE 1.0 END"
    weight = f"(ln(1.0 + 9.0 * {hidden}) / ln(10.0)) * ({fade}) * ({normal})"
    near, far = unit(f"({zoom} - 0.58) / 0.57"), unit(f"(0.85 - {zoom}) / 0.65")
    return f"CASE WHEN {total} <= 0 THEN 1.0 ELSE (1.0 + {weight} * 1.45 * (1.0 - {near})) * (1.0 + {far} * 0.45 * {weight}) END"


def tick_delay(elapsed: str) -> str:
    """Milliseconds to wait for 60 ticks a second."""
    return f"greatest(0.0, 1000.0 / 60.0 - {elapsed})"


def article_degree(i: str, o: str) -> str:
    return f"greatest(0, coalesce({i}, 0) + coalesce({o}, 0))"


def article_bytes(size: str, length: str) -> str:
    """Size, else length, else 0; what is not finite or positive is 0."""
    x = f"coalesce({size}, {length}, 0.0)"
    return f"greatest(0.0, {finite(x)})"


def safe_direction(dx: str, dy: str, a: str, b: str) -> tuple[str, str]:
    """Unit vector of a pair; a component of 0 is jiggled."""
    x = f"CASE WHEN {dx} = 0 THEN {jiggle(a, b, 0)} ELSE {dx} END"
    y = f"CASE WHEN {dy} = 0 THEN {jiggle(a, b, 1)} ELSE {dy} END"
    d = f"greatest(0.000000000001, sqrt(({x}) * ({x}) + ({y}) * ({y})))"
    return f"({x}) / {d}", f"({y}) / {d}"


def project(x: str, y: str, z: str, yaw: float, pitch: float, camera: str) -> dict[str, str]:
    """Screen place, depth and perspective of a point in space (D9); scale and origin of the view come after."""
    yx, yz = f"({x} * cos({yaw}) - {z} * sin({yaw}))", f"({x} * sin({yaw}) + {z} * cos({yaw}))"
    depth = f"({y} * sin({pitch}) + {yz} * cos({pitch}))"
    p = f"greatest(0.42, least(1.8, {camera} / greatest(1.0, {camera} + {depth})))"
    return {"px": f"{yx} * {p}", "py": f"({y} * cos({pitch}) - {yz} * sin({pitch})) * {p}", "depth": depth, "perspective": p}


def camera_distance(n: str) -> str:
    return f"greatest(900.0, 3.0 * ({boundary_radius(n, True)}))"


def in_view(x: str, y: str, r: str, view: tuple[float, float, float, float]) -> str:
    """A circle's box meets the rectangle (left, top, right, bottom)."""
    return f"({x} + {r} >= {view[0]} AND {x} - {r} <= {view[2]} AND {y} + {r} >= {view[1]} AND {y} - {r} <= {view[3]})"


def boxes_overlap(a: dict[str, str], b: dict[str, str], padding: float = 0.0) -> str:
    """Two rectangles of left, top, right, bottom come nearer than padding."""
    return f"({a['left']} < {b['right']} + {padding} AND {a['right']} > {b['left']} - {padding} AND {a['top']} < {b['bottom']} + {padding} AND {a['bottom']} > {b['top']} - {padding})"


def circle_touches(x: str, y: str, r: str, box: dict[str, str], padding: float = 0.0) -> str:
    """A circle comes nearer to a rectangle than padding."""
    nx, ny = f"greatest({box['left']}, least({x}, {box['right']}))", f"greatest({box['top']}, least({y}, {box['bottom']}))"
    return f"(sqrt(({x} - {nx}) * ({x} - {nx}) + ({y} - {ny}) * ({y} - {ny})) < {r} + {padding})"


def initial_scale(n: str, width: float, height: float) -> str:
    """Zoom at which the whole boundary is seen."""
    return f"greatest(0.02, least(2.2, {0.86 * min(width, height)!r} / (2.0 * ({boundary_radius(n)}) + 80.0)))"


def label_budget(count: str, zoom: float, hubs: str) -> str:
    """How many labels are drawn, by the number of candidates, zoom and hubs."""
    boost = 2.2 if zoom >= 1.45 else 1.55 if zoom >= 1.05 else 0.7 if zoom < 0.5 else 1.0
    base = f"CASE WHEN {count} <= 40 THEN 8 WHEN {count} <= 100 THEN 12 WHEN {count} <= 250 THEN 18 WHEN {count} <= 800 THEN 28 ELSE 420 END"
    return f"CASE WHEN {count} <= 12 THEN {count} ELSE least({count}, greatest({hubs} + 4, CAST(ceil(({base}) * {boost}) AS BIGINT))) END"


def label_priority(active: str, hub: str, degree: str) -> str:
    return f"CASE WHEN {active} THEN 1000000 WHEN {hub} THEN 100000 + {degree} * 10 ELSE {degree} END"


def seeded_random(seed: int):
    """A 32-bit mixing generator of numbers from 0 to 1, for seeds that a driver needs in order (B31). The shifts and multipliers."""
    mask = 0xFFFFFFFF
    state = (seed & mask) or 1
    while True:
        state = (state ^ state >> 15) * (1 | state) & mask
        state ^= state + ((state ^ state >> 7) * (61 | state) & mask) & mask
        yield ((state ^ state >> 14) & mask) / 4294967296
