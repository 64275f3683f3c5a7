"""A tree of reference frames, and transforms folded along its paths.

Each edge child -> parent has a pose: a constant, or a LaneFrame of poses over time. A path goes up to the common
ancestor and down again; poses over time are interpolated at the rows' clock, then everything is one column expression.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions import motion as mo
from wayline.functions import spatial as sp
from wayline.operators import asof


#: Classes of motion and inertial statuses: fixed values.
MOTIONS, INERTIAL = ("static", "galilean", "dynamic", "unknown"), ("inertial", "non_inertial", "unknown")


@dataclass(frozen=True)
class Step:
    """One edge of a path; inverted: walked from parent to child."""

    child: str
    parent: str
    inverted: bool


@dataclass
class FrameGraph:
    parents: dict[str, str | None] = field(default_factory=dict)
    edges: dict[str, Any] = field(default_factory=dict)  # child -> its pose in the parent
    frozen: bool = False
    motions: dict[str, str] = field(default_factory=dict)  # child -> class of its motion in the parent
    inertial: dict[str, str] = field(default_factory=dict)  # frame -> inertial status

    def _open(self) -> None:
        if self.frozen:
            raise RuntimeError("the graph is frozen")

    def add(self, name: str, parent: str | None = None, reparent: bool = False) -> str:
        """A frame, made if it isn't there; a different parent needs reparent."""
        if name in self.parents and (parent is None or self.parents[name] == parent):
            return name
        self._open()
        if name in self.parents and self.parents[name] is not None and not reparent:
            raise ValueError(f"{name} already has the parent {self.parents[name]}")
        if parent is not None:
            self.parents.setdefault(parent, None)
            if name in self.ancestors(parent):
                raise ValueError(f"{name} would be its own ancestor")
        self.parents[name] = parent
        self.edges.pop(name, None)
        return name

    def rename(self, old: str, new: str) -> None:
        self._open()
        if new in self.parents:
            raise ValueError(f"there is a frame {new}")
        self.parents = {new if k == old else k: new if v == old else v for k, v in self.parents.items()}
        for held in (self.edges, self.motions, self.inertial):
            if old in held:
                held[new] = held.pop(old)

    def remove(self, name: str, subtree: bool = True) -> None:
        self._open()
        below = [k for k in self.parents if name in self.ancestors(k)]
        if len(below) > 1 and not subtree:
            raise ValueError(f"{name} has frames below it")
        for k in below:
            self.parents.pop(k)
            for held in (self.edges, self.motions, self.inertial):
                held.pop(k, None)

    def set_motion_class(self, child: str, kind: str) -> None:
        """How a frame moves in its parent: static, galilean (evenly), dynamic or unknown."""
        if kind not in MOTIONS:
            raise ValueError(f"unknown edge motion class {kind}")
        self._open()
        self.motions[child] = kind

    def motion_class(self, child: str) -> str:
        return self.motions.get(child, "unknown")

    def set_inertial(self, name: str, status: str) -> None:
        if status not in INERTIAL:
            raise ValueError(f"unknown inertial status {status}")
        self._open()
        self.inertial[name] = status

    def inertial_status(self, name: str) -> str:
        """The frame's own status, or what follows from its parent's and the motion between them."""
        if name in self.inertial or self.parents[name] is None:
            return self.inertial.get(name, "unknown")
        above, kind = self.inertial_status(self.parents[name]), self.motion_class(name)
        if above != "inertial" or kind == "unknown":
            return "unknown"
        return "non_inertial" if kind == "dynamic" else "inertial"

    def resolve(self, frame: LaneFrame) -> dict[str, str | None]:
        """The frame ids of a LaneFrame, which must be in the graph."""
        ids = frame.frame_ids()
        if missing := [v for v in ids.values() if v is not None and v not in self.parents]:
            raise KeyError(f"no frames {missing}")
        return ids

    def snapshot(self, seeds: list[str] | None = None, include_unreachable: bool = True) -> dict[str, dict]:
        """What is known of every frame; with seeds, of those in their trees, and of the others only if asked for."""
        roots = {self.ancestors(s)[-1] for s in seeds} if seeds else None
        kept = [n for n in self.parents if roots is None or include_unreachable or self.ancestors(n)[-1] in roots]
        return {n: {"parent": self.parents[n], "bound": n in self.edges, "motion": self.motion_class(n), "inertial": self.inertial_status(n), "reachable": roots is None or self.ancestors(n)[-1] in roots} for n in kept}

    def bind(self, parent: str, child: str, provider: Any, on_conflict: str = "error") -> None:
        """The pose of child in parent: a pose Column, a LaneFrame with a pose field, or a function of the step that gives either."""
        if child in self.edges and on_conflict == "error":
            raise ValueError(f"{child} already has a pose")
        self.add(child, parent, reparent=on_conflict == "replace")
        self.edges[child] = provider

    def ancestors(self, name: str) -> list[str]:
        """The frame itself, its parent, and so on."""
        if name not in self.parents:
            raise KeyError(f"no frame {name}")
        out = [name]
        while (up := self.parents[out[-1]]) is not None:
            out.append(up)
        return out

    def path(self, src: str, dst: str) -> list[Step]:
        up, down = self.ancestors(src), self.ancestors(dst)
        shared = next((x for x in up if x in down), None)
        if shared is None:
            raise ValueError(f"no path from {src} to {dst}")
        rise = [Step(c, self.parents[c], False) for c in up[: up.index(shared)]]
        fall = [Step(c, self.parents[c], True) for c in reversed(down[: down.index(shared)])]
        return rise + fall

    def text(self) -> str:
        """The trees as indented lines."""

        def lines(name: str, depth: int) -> list[str]:
            below = sorted(k for k, v in self.parents.items() if v == name)
            return ["  " * depth + name, *itertools.chain.from_iterable(lines(k, depth + 1) for k in below)]

        return "\n".join(itertools.chain.from_iterable(lines(k, 0) for k, v in sorted(self.parents.items()) if v is None))


def fold_path(path: list[Step], value: Callable[[Step], Any], compose: Callable, inverse: Callable, identity: Any) -> Any:
    """Edge values along a path put together in order."""
    out = identity
    for step in path:
        v = value(step)
        v = inverse(v) if step.inverted else v
        out = v if out is identity else compose(out, v)
    return out


#: The pose that changes nothing.
def identity_pose() -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return sp.pose(sp.vector(zero, zero, zero), sp.quaternion(zero, zero, zero, one))


def _alpha(q: Column) -> Column:
    width = (F.col("__right.t") - F.col("__left.t")).cast("double")
    return (q - F.col("__left.t")).cast("double") / F.when(width != 0, width)


def _policy(q: Column, duplicates: str, exact: Column, first: Column, last: Column, inner: Column) -> Column:
    """The value at a query: the sample itself at the lane's ends, by the policy at repeated clock values, else the blend."""
    many = F.col("__right.again") & (q == F.col("__right.t"))
    end = (q == F.col("__right.t")) & (F.col("__left").isNull() | (q == F.col("__end")))
    fault = F.when(F.raise_error(F.lit("a query meets repeated clock values")).cast("boolean"), exact)
    taken = {"invalid": F.when(F.lit(False), exact), "left": first, "right": last, "raise": fault}[duplicates]
    return F.when(many, taken).when(end, exact).otherwise(inner)


def _bracketed(samples: LaneFrame, name: str, queries: DataFrame, on: str, duplicates: str) -> tuple[DataFrame, Column]:
    if duplicates not in asof.POLICIES:
        raise ValueError(f"unknown policy {duplicates}")
    found = asof.bracket(samples.select(name), queries, on, last_of_equal=duplicates == "right")
    return found, F.col(f"__upto.{name}") if duplicates == "right" else F.col(f"__right.{name}")


def interpolated_rotations(samples: LaneFrame, name: str, queries: DataFrame, on: str, output: str, method: str = "slerp", duplicates: str = "invalid") -> DataFrame:
    """queries with the rotation at their clock; method: slerp, linear (blended and normalised) or nearest (clamped outside, ties go left)."""
    q = asof.ticks_of(queries, on)
    found, last = _bracketed(samples, name, queries, on, duplicates)
    a, b = F.col(f"__left.{name}"), F.col(f"__right.{name}")
    if method == "nearest":
        return found.select(*queries.columns, F.when(q.isNotNull(), F.when(asof._nearest_left(q), a).otherwise(b)).alias(output))
    if method == "slerp":
        found = sp.with_slerp(found, a, b, _alpha(q), "__inner")
    elif method == "linear":
        k = _alpha(q)
        sign = F.when(sp.qdot(a, b) < 0, -1.0).otherwise(1.0)
        found = found.withColumn("__mixed", sp.quaternion(*((1 - k) * a[c] + k * sign * b[c] for c in sp.QUATERNION))).withColumn("__inner", F.when(k.isNotNull(), sp.normalised(F.col("__mixed"))))
    else:
        raise ValueError(f"unknown method {method}")
    return found.select(*queries.columns, _policy(q, duplicates, b, b, last, F.col("__inner")).alias(output))


def interpolated_poses(poses: LaneFrame, name: str, queries: DataFrame, on: str, output: str, duplicates: str = "invalid", rotation: str = "slerp", position: str = "linear") -> DataFrame:
    """queries with the pose at their clock: position blended, rotation by slerp, or either from the nearest sample; missing outside the clock."""
    q = asof.ticks_of(queries, on)
    found, last = _bracketed(poses, name, queries, on, duplicates)
    a, b = F.col(f"__left.{name}"), F.col(f"__right.{name}")
    left, k = asof._nearest_left(q), F.col("__alpha")
    found = found.withColumn("__alpha", _alpha(q))
    if rotation == "slerp":
        found = sp.with_slerp(found, a["q"], b["q"], k, "__turn")
    else:
        found = found.withColumn("__turn", F.when(left, a["q"]).otherwise(b["q"]))
    p = sp.vadd(sp.vscale(a["p"], 1 - k), sp.vscale(b["p"], k)) if position == "linear" else F.when(left, a["p"]).otherwise(b["p"])
    inner = F.when(F.col("__left").isNotNull() & F.col("__right").isNotNull(), sp.pose(p, F.col("__turn")))
    return found.select(*queries.columns, _policy(q, duplicates, b, b, last, inner).alias(output))


def resampled_rotations(samples: LaneFrame, name: str, grid: DataFrame, method: str = "slerp", duplicates: str = "invalid") -> LaneFrame:
    """A frame of rotations on another clock (lane keys, seq, clock)."""
    at = grid.select(*samples.keys, samples.seq, samples.clock)
    return samples.select(name).over(interpolated_rotations(samples, name, at, samples.clock, name, method, duplicates))


def resampled_poses(poses: LaneFrame, name: str, grid: DataFrame, duplicates: str = "invalid", rotation: str = "slerp", position: str = "linear") -> LaneFrame:
    """A frame of poses on another clock (lane keys, seq, clock)."""
    at = grid.select(*poses.keys, poses.seq, poses.clock)
    return poses.select(name).over(interpolated_poses(poses, name, at, poses.clock, name, duplicates, rotation, position))


def _edge_values(graph: FrameGraph, rows: LaneFrame, path: list[Step], field: str, interpolate: Callable) -> tuple[DataFrame, list[Column]]:
    """rows with the value of every edge of a path at their clock, and the columns of these values in the path's order.

    An edge is a Column, a LaneFrame of the rows' lanes over time, or a function of the step that gives either.
    """
    df, made = rows.df, []
    for i, step in enumerate(path):
        edge = graph.edges.get(step.child)
        edge = edge(step) if callable(edge) and not isinstance(edge, Column) else edge
        if edge is None:
            raise ValueError(f"no pose for {step.child} in {step.parent}")
        if isinstance(edge, LaneFrame):
            df = interpolate(edge, field, df, rows.clock, f"__edge{i}")
            edge = F.col(f"__edge{i}")
        made.append(edge)
    return df, made


def with_path(graph: FrameGraph, rows: LaneFrame, src: str, dst: str, output: str = "transform", pose_field: str = "pose") -> DataFrame:
    """rows with the pose that takes src into dst, edges over time taken at the rows' clock.

    A LaneFrame edge has the rows' lane keys; it is joined as of the clock.
    """
    path = graph.path(src, dst)
    df, edges = _edge_values(graph, rows, path, pose_field, interpolated_poses)
    if not path:
        return df.withColumn(output, identity_pose())
    walked = [sp.pose_inverse(e) if s.inverted else e for s, e in zip(path, edges, strict=True)]
    return sp.with_composed(df, walked, output).drop(*(f"__edge{i}" for i in range(len(path))))


def with_rotation_path(graph: FrameGraph, rows: LaneFrame, src: str, dst: str, output: str = "rotation", rotation_field: str = "rotation", poses: bool = False) -> DataFrame:
    """rows with the rotation that takes the basis of src into that of dst; edges are rotations, or with ``poses`` poses of which only the turn counts."""
    path = graph.path(src, dst)
    df, edges = _edge_values(graph, rows, path, rotation_field, interpolated_poses if poses else interpolated_rotations)
    zero, one = F.lit(0.0), F.lit(1.0)
    df = df.withColumn(output, sp.quaternion(zero, zero, zero, one))
    for step, e in zip(path, edges, strict=True):
        turn = e["q"] if poses else e
        df = df.withColumn(output, sp.rotation_compose(F.col(output), sp.rotation_inverse(turn) if step.inverted else turn))
    return df.drop(*(f"__edge{i}" for i in range(len(path))))


def to_frame(graph: FrameGraph, rows: LaneFrame, point: str, src: str, dst: str) -> LaneFrame:
    """A point field given in src, in dst; a frame of displacements (``as_delta``) is turned only."""
    df = with_path(graph, rows, src, dst, "__transform")
    turned = sp.rotate(F.col("__transform.q"), F.col(point)) if rows.attrs.get("intent") == "delta" else sp.pose_apply(F.col("__transform"), F.col(point))
    return rows.over(df.withColumn(point, turned).drop("__transform")).retag(parent=dst)


def as_delta(rows: LaneFrame) -> LaneFrame:
    """The frame's positions as displacements."""
    return rows.retag(intent="delta")


def express_in(graph: FrameGraph, rows: LaneFrame, vector: str, src: str, dst: str) -> LaneFrame:
    """A vector field with its components in the basis of dst: turned, not moved."""
    df = with_path(graph, rows, src, dst, "__transform")
    return rows.over(df.withColumn(vector, sp.rotate(F.col("__transform.q"), F.col(vector))).drop("__transform")).retag(expressed_in=dst)


def express_motion(graph: FrameGraph, rows: LaneFrame, field: str, src: str, dst: str) -> LaneFrame:
    """A motion field (linear and angular part) with its components in the basis of dst."""
    df = with_path(graph, rows, src, dst, "__transform")
    return rows.over(df.withColumn(field, mo.turned(F.col("__transform.q"), F.col(field))).drop("__transform")).retag(expressed_in=dst)


#: Motion classes whose edges add a motion of their own, by what is moved: fixed values.
MOVING = {"velocity": ("galilean", "dynamic"), "acceleration": ("dynamic",)}


def couple_motion(
    graph: FrameGraph, rows: LaneFrame, field: str, src: str, dst: str, motion: Callable[[Step], Column | None] | None, pair: bool = False, kind: str | None = None,
    edge_class: Callable[[Step], str] | None = None, inertial_roles: Sequence[str] = (), frame_status: Callable[[str], str] | None = None,
) -> LaneFrame:
    """A velocity or acceleration field of src in dst: turned, with each edge's own motion (in dst's basis) added, or taken off on inverted steps.

    pair: the field and the edges' motions have a linear and an angular part. kind: velocity or acceleration (default: what the frame's attribute ``kind``
    says, else velocity). Velocities need the motion of galilean and dynamic edges, accelerations of dynamic ones; static ones move nothing. An edge of unknown
    class needs a motion. edge_class, frame_status: functions that say the classes and statuses instead of the graph. inertial_roles: parent (src) and child
    (the frame that moves in it, the frame id ``child``) must be inertial.
    """
    named = kind or ("acceleration" if "acceleration" in rows.attrs.get("kind", "") else "velocity")
    if named not in MOVING:
        raise ValueError(f"{named} is neither a velocity nor an acceleration")
    for role in inertial_roles:
        if role not in ("parent", "child"):
            raise ValueError(f"unknown inertial role {role}")
        frame = src if role == "parent" else rows.frame_ids()["child"]
        if frame is None or frame not in graph.parents:
            raise ValueError(f"the {role} needs a frame of the graph")
        if (frame_status or graph.inertial_status)(frame) != "inertial":
            raise ValueError(f"the {role} {frame} is not known to be inertial")
    wanted = []
    for step in graph.path(src, dst):
        of = edge_class(step) if edge_class else graph.motion_class(step.child)
        if of not in MOTIONS:
            raise ValueError(f"unknown edge motion class {of}")
        if of == "static" or of != "unknown" and of not in MOVING[named]:
            continue
        if motion is None or (m := motion(step)) is None:
            raise ValueError(f"no motion of {step.child} in {step.parent}, which is {of}")
        wanted.append((step, m))
    moved = express_motion(graph, rows, field, src, dst) if pair else express_in(graph, rows, field, src, dst)
    add, sub = (mo.madd, mo.msub) if pair else (sp.vadd, sp.vsub)
    out = F.col(field)
    for step, m in wanted:
        out = sub(out, m) if step.inverted else add(out, m)
    return moved.with_fields(**{field: out}).retag(parent=dst)
