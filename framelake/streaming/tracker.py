"""Online assignment of detections to tracks, as a stateful operator on streams or batches of frames."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Rules:
    """Confidence a new track needs; frames a track lives on without detection; cover an assignment needs
    once a track has a velocity; confidences of a track that count (evenly spaced, from the last one
    back); pixels within which a detection that meets no track may still be the next of one (0: none);
    cover by a known track that keeps a detection from becoming a new one."""

    min_conf: float = 0.2
    history: int = 5
    min_cover: float = 0.2
    conf_samples: int = 4
    gate: float = 0.0
    explained: float = 0.7


def measures(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(iou, iou of the shapes, larger cover) of the boxes of a with those of b, row by row."""
    size = lambda x: np.maximum(x[:, 2:] - x[:, :2], 0.0)
    sa, sb = size(a), size(b)
    area_a, area_b = sa.prod(1), sb.prod(1)
    meet = np.maximum(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0.0).prod(1)
    shape = np.minimum(sa, sb).prod(1)
    share = lambda x, y: np.divide(x, y, out=np.zeros(len(x)), where=y > 0)
    return share(meet, area_a + area_b - meet), share(shape, area_a + area_b - shape), np.maximum(share(meet, area_a), share(meet, area_b))


def meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of boxes of a and of b that overlap, in order."""
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int)
    hit = (a[:, None, 0] < b[None, :, 2]) & (a[:, None, 2] > b[None, :, 0])
    hit &= (a[:, None, 1] < b[None, :, 3]) & (a[:, None, 3] > b[None, :, 1])
    return np.nonzero(hit)


def best_first(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs (i, j), in order of i and j, those that are taken if the largest score goes first and its i
    and j are struck out, again and again; equal scores go by i, then j."""
    order = np.argsort(-score, kind="stable")
    left = min(len(np.unique(i)), len(np.unique(j)))
    had, got, taken = set(), set(), []
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        if y in got or x in had:
            continue
        had.add(x)
        got.add(y)
        taken.append((x, y))
        if len(taken) == left:
            break
    return taken


@dataclass
class Tracks:
    """Live tracks as columns, in order of their ids: two latest boxes with their frames, all confidences, and
    the mean of those that count (None: not known yet)."""

    ids: list[int] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    frames: list[list[int]] = field(default_factory=list)
    boxes: list[list[list[float]]] = field(default_factory=list)
    confs: list[list[float]] = field(default_factory=list)
    means: list[float | None] = field(default_factory=list)

    def keep(self, rows: list[int]) -> None:
        if len(rows) == len(self.ids):
            return
        for name in ("ids", "kinds", "frames", "boxes", "confs", "means"):
            column = getattr(self, name)
            setattr(self, name, [column[i] for i in rows])

    def at(self, frame: int) -> np.ndarray:
        """Boxes moved on with the constant velocity of their centres."""
        last = np.array([b[-1] for b in self.boxes], float).reshape(-1, 4)
        before = np.array([b[0] for b in self.boxes], float).reshape(-1, 4)
        t = np.array([[f[0], f[-1]] for f in self.frames], float).reshape(-1, 2)
        ahead = np.divide(frame - t[:, 1], t[:, 1] - t[:, 0], out=np.zeros(len(t)), where=t[:, 1] > t[:, 0])
        middle = lambda x: (x[:, :2] + x[:, 2:]) / 2
        move = (middle(last) - middle(before)) * ahead[:, None]
        return last + np.concatenate([move, move], axis=1)

    def confidence(self, samples: int) -> np.ndarray:
        for i, c in enumerate(self.confs):
            if self.means[i] is None:
                self.means[i] = float(np.mean(c[:: -max(1, round(len(c) / samples))])) if len(c) > 1 else c[0]
        return np.array(self.means, float)

    def extend(self, i: int, frame: int, box: list[float], conf: float) -> None:
        self.frames[i] = [self.frames[i][-1], frame]
        self.boxes[i] = [self.boxes[i][-1], box]
        self.confs[i].append(conf)
        self.means[i] = None

    def add(self, ident: int, kind: str, frame: int, box: list[float], conf: float) -> None:
        self.ids.append(ident)
        self.kinds.append(kind)
        self.frames.append([frame])
        self.boxes.append([box])
        self.confs.append([conf])
        self.means.append(None)


class Tracker:
    """Assigns the detections of one video's frames, in order, to its tracks."""

    def __init__(self, state: str | None = None, **rules: float):
        kept = json.loads(state) if state else {"made": 0, "tracks": {}}
        self.made, self.tracks, self.rules = kept["made"], Tracks(**kept["tracks"]), Rules(**rules)

    def state(self) -> str:
        return json.dumps({"made": self.made, "tracks": asdict(self.tracks)})

    def step(self, frame: int, dets: list[tuple[int, str, float, tuple]]) -> list[tuple[int, int]]:
        """(detection, track) of one frame's detections (id, category, conf, box); others found no track.

        Each track has a score with every detection of its kind that it overlaps. The largest one is taken
        and its track and detection are struck out, until none is left; equal ones go by the order of the
        tracks, then of the detections. What is left of the detections may be near a track that got none
        (gate), or begins a new one where no track explains it."""
        t, rules = self.tracks, self.rules
        t.keep([i for i, f in enumerate(t.frames) if frame - f[-1] <= rules.history])
        if not dets:
            return []
        boxes, conf = np.array([d[3] for d in dets], float), np.array([d[2] for d in dets], float)
        where, kinds, of = t.at(frame), np.array(t.kinds, object), np.array([d[1] for d in dets], object)
        explained = np.full(len(dets), rules.explained <= 0 and len(t.ids) > 0)
        needed = np.where([len(c) > 1 for c in t.confs], rules.min_cover, 0.0)
        known = t.confidence(rules.conf_samples)
        track_of: dict[int, int] = {}
        for kind in dict.fromkeys(d[1] for d in dets):
            own, new = np.flatnonzero(kinds == kind), np.flatnonzero(of == kind)
            i, j = meeting(where[own], boxes[new])
            i, j = own[i], new[j]
            iou, shape, cover = measures(where[i], boxes[j])
            explained[j[cover >= rules.explained]] = True
            fit = (iou > 0) & (cover > needed[i])
            i, j = i[fit], j[fit]
            score = (conf + conf.min())[j] * (iou + shape + cover)[fit] + known[i]
            track_of |= {y: x for x, y in best_first(i, j, score)}
        free = np.ones(len(t.ids), bool)
        free[list(track_of.values())] = False
        new = []
        for j in range(len(dets)):
            if j in track_of or conf[j] < rules.min_conf or explained[j]:
                continue
            near = np.flatnonzero(free & (kinds == dets[j][1]) & self._gated(where, boxes[j])) if rules.gate > 0 else []
            if len(near):
                i = int(near[np.argmin(((where[near, :2] - boxes[j, :2]) ** 2).sum(1))])
                track_of[j], free[i] = i, False
            else:
                new.append(j)
        for j, i in track_of.items():
            t.extend(i, frame, boxes[j].tolist(), float(conf[j]))
        out = [(dets[j][0], t.ids[i]) for j, i in sorted(track_of.items())]
        for j in new:
            t.add(self.made, dets[j][1], frame, boxes[j].tolist(), float(conf[j]))
            out.append((dets[j][0], self.made))
            self.made += 1
        return out

    def _gated(self, where: np.ndarray, box: np.ndarray) -> np.ndarray:
        side = np.minimum(where[:, 2:], box[2:]) - np.maximum(where[:, :2], box[:2])
        return (side > -self.rules.gate).all(1)


OUT = "video_id bigint, frame int, det_id bigint, track_id bigint"
COLUMNS = ["video_id", "frame", "det_id", "track_id"]


def _frames(pdf: pd.DataFrame) -> Iterator[tuple[int, list]]:
    for frame, g in pdf.sort_values(["frame", "det_id"]).groupby("frame", sort=True):
        yield int(frame), [(int(r.det_id), r.category, float(r.conf), (r.xmin, r.ymin, r.xmax, r.ymax)) for r in g.itertuples()]


def assign_stream(dets: DataFrame, **rules: float) -> DataFrame:
    """Stream of (video_id, frame, det_id, category, conf, xmin, ymin, xmax, ymax) to (det, track).

    All detections of a frame must arrive in one batch, frames that come after a later one are left
    out; state is the tracks not older than `history`. df has a watermark: a video without
    detections for a day of event time loses its state. Detections without confidence are left out."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        upto, kept = state.get if state.exists else (-1, None)
        t = Tracker(kept, **rules)
        rows = []
        for f, ds in _frames(pd.concat(list(frames))):
            if f > upto:
                rows += [(key[0], f, d, k) for d, k in t.step(f, ds)]
                upto = f
        state.update((upto, t.state()))
        state.setTimeoutTimestamp(max(1, state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame(rows, columns=COLUMNS).astype("int64")

    return dets.where("conf is not null").groupBy("video_id").applyInPandasWithState(run, OUT, "upto bigint, tracks string", "append", GroupStateTimeout.EventTimeTimeout)


def assign_batch(dets: DataFrame, **rules: float) -> DataFrame:
    """The same over a batch: frames of a video in order. Tasks read sorted rows and hold one frame and
    the live tracks of one video, whatever the length of the video; videos are independent."""
    tasks = int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dets.where("conf is not null and video_id is not null and frame is not null")
    rows = rows.select("video_id", "frame", "det_id", "category", "conf", "xmin", "ymin", "xmax", "ymax").repartition(tasks, "video_id").sortWithinPartitions("video_id", "frame", "det_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, t, rest = None, None, None
        for pdf in _with_end(batches):
            last = pdf is None
            whole = rest if last else (pdf if rest is None else pd.concat([rest, pdf]))
            if whole is None or not len(whole):
                continue
            # The last frame may go on in the next batch.
            end = np.zeros(len(whole), bool) if last else ((whole["video_id"] == whole["video_id"].iloc[-1]) & (whole["frame"] == whole["frame"].iloc[-1])).to_numpy()
            rest = None if last else whole[end]
            out = []
            for v, g in whole[~end].groupby("video_id", sort=False):
                if v != video:
                    video, t = v, Tracker(**rules)
                out += [(int(v), f, d, k) for f, ds in _frames(g) for d, k in t.step(f, ds)]
            yield pd.DataFrame(out, columns=COLUMNS)

    return rows.mapInPandas(run, OUT)


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def assign_activities(acts: DataFrame, min_iou: float = 0.5, merge: bool = True, suppress: bool = False) -> DataFrame:
    """Activities (video_id, category, actor_id, startframe, endframe, conf) as they come in order of their
    starts (ties: end, larger conf), brought together with earlier ones of the same video, category and
    actor whose span they overlap with a temporal IoU of min_iou or more: merged into the first such one,
    whose span grows, or (suppress) the less confident of the two is left out; otherwise they stay.

    Tasks read sorted rows and hold only the activities of one key that a later one may still overlap."""
    key = ["video_id", "category", "actor_id"]
    tasks = int(acts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = acts.where("video_id is not null and startframe < endframe").select(*key, "startframe", "endframe", F.coalesce("conf", F.lit(0.0)).alias("conf"))
    rows = rows.repartition(tasks, *key).sortWithinPartitions(*key, "startframe", "endframe", F.desc("conf"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, live = None, []
        for pdf in _with_end(batches):
            done = []
            for r in pdf.itertuples(index=False) if pdf is not None else ():
                k = tuple(None if v is None or v != v else v for v in (r.video_id, r.category, r.actor_id))
                closed = live if k != own else [x for x in live if x[1] <= r.startframe]
                done += [(*own, *x) for x in closed]
                live = [] if k != own else [x for x in live if x[1] > r.startframe]
                own = k
                met = next((x for x in live if (min(x[1], r.endframe) - r.startframe) >= min_iou * (max(x[1], r.endframe) - x[0])), None)
                if met is None or not (merge or suppress):
                    live.append([int(r.startframe), int(r.endframe), float(r.conf)])
                elif merge:
                    met[1], met[2] = max(met[1], int(r.endframe)), max(met[2], float(r.conf))
                elif r.conf > met[2]:
                    live[live.index(met)] = [int(r.startframe), int(r.endframe), float(r.conf)]
            if pdf is None:
                done += [(*own, *x) for x in live]
            yield pd.DataFrame(done, columns=[*key, "startframe", "endframe", "conf"]).astype({"actor_id": "Int64", "video_id": "Int64"})

    return rows.mapInPandas(run, f"video_id {kinds['video_id']}, category string, actor_id {kinds['actor_id']}, startframe int, endframe int, conf double")
