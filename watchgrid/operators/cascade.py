"""The temporal cascade as a pure state machine; no Spark here, so batch and streaming share it.

One ``Cascade`` validates one (configuration, camera, hazard). Frames are numbered densely in processing order, so a
frame without detections needs no call: the number of the next frame tells how many were missed.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class ValidatorConfig:
    """One configuration of the cascade. ``hazard`` None applies it to every hazard."""

    config_id: str = "default"
    hazard: str | None = None
    enable_confidence: bool = True
    min_confidence: float = 0.20
    enable_persistence: bool = True
    min_frames: int = 3
    track_iou: float = 0.2
    max_misses: int = 5
    low_confidence_association: bool = False
    association_floor: float = 0.05
    enable_cooldown: bool = True
    cooldown_seconds: float = 60.0
    cooldown_iou: float = 0.3

    def with_(self, **changes) -> "ValidatorConfig":
        return replace(self, **changes)

    def floor_needed(self) -> float | None:
        """The weakest confidence the ordered pass must see; None means all of them."""
        if not self.enable_confidence:
            return None
        if self.low_confidence_association:
            return min(self.min_confidence, self.association_floor)
        return self.min_confidence

    def as_row(self) -> dict:
        return asdict(self)


#: Per-hazard operating points that results must agree with.
DEFAULT_SETTINGS = {
    "fire": dict(min_confidence=0.20, min_frames=3),
    "flood": dict(min_confidence=0.50, min_frames=2, cooldown_seconds=300.0),
    "traffic": dict(min_confidence=0.25, min_frames=3),
    "drowning": dict(min_confidence=0.30, min_frames=3),
    "building_access": dict(min_confidence=0.20, min_frames=3),
}


def default_configs(config_id: str = "default", **overrides) -> list[ValidatorConfig]:
    return [
        ValidatorConfig(config_id=config_id, hazard=hazard, **{**settings, **overrides})
        for hazard, settings in DEFAULT_SETTINGS.items()
    ]


CONFIDENCE, PERSISTENCE, COOLDOWN = "confidence", "persistence", "cooldown"
LEVELS = (CONFIDENCE, PERSISTENCE, COOLDOWN)


def box_iou(a, b) -> float:
    """Overlap of two (x1, y1, x2, y2) tuples. Boxes that share no area leave early, which is the common case."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    wide = (ax2 if ax2 < bx2 else bx2) - (ax1 if ax1 > bx1 else bx1)
    if wide <= 0.0:
        return 0.0
    high = (ay2 if ay2 < by2 else by2) - (ay1 if ay1 > by1 else by1)
    if high <= 0.0:
        return 0.0
    inter = wide * high
    return inter / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter)


class Track:
    __slots__ = ("box", "seen", "hits", "peak", "total", "first_frame", "first_ts", "label", "local_hits")

    def __init__(self, box, seen, hits, peak, total, first_frame, first_ts, label):
        self.box, self.seen, self.hits, self.peak, self.total = box, seen, hits, peak, total
        self.first_frame, self.first_ts, self.label = first_frame, first_ts, label
        self.local_hits = hits

    def hit(self, box, number, confidence):
        self.box, self.seen = box, number
        self.hits += 1
        self.local_hits += 1
        self.peak = max(self.peak, confidence)
        self.total += confidence


class Cascade:
    """State: live tracks in creation order, boxes confirmed recently, and the number of tracks opened so far."""

    def __init__(self, config: ValidatorConfig, opened: int = 0):
        self.config = config
        self.tracks: list[Track] = []
        self.recent: list[tuple] = []
        self.opened = opened

    def frame(self, number: int, frame_index: int, ts: float, detections) -> list[tuple]:
        """Process one frame. ``detections``: (confidence, box) in input order.
        Returns, per detection, (rejected_by, track label, hits, peak and mean confidence, first frame, first time)."""
        config = self.config
        out: list = [None] * len(detections)
        strong, weak = [], []
        for i, (confidence, _) in enumerate(detections):
            if config.enable_confidence and confidence < config.min_confidence:
                out[i] = (CONFIDENCE, None, None, None, None, None, None)
                if confidence >= config.association_floor:
                    weak.append(i)
            else:
                strong.append(i)
        if len(strong) > 1:
            strong.sort(key=lambda i: -detections[i][0])

        horizon = number - config.max_misses - 1
        free = [t for t in self.tracks if t.seen >= horizon]
        opened: list[Track] = []
        pairs = []
        for i in strong:
            confidence, box = detections[i]
            track = self._claim(box, free)
            if track is None:
                self.opened += 1
                track = Track(box, number, 1, confidence, confidence, frame_index, ts, self.opened)
                opened.append(track)
            else:
                free.remove(track)
                track.hit(box, number, confidence)
            pairs.append((i, track))
        self.tracks = [t for t in self.tracks if t.seen > horizon] + opened

        if config.low_confidence_association and weak:
            weak.sort(key=lambda i: -detections[i][0])
            waiting = [t for t in self.tracks if t.seen < number]
            for i in weak:
                track = self._claim(detections[i][1], waiting)
                if track is not None:
                    waiting.remove(track)
                    track.box, track.seen = detections[i][1], number

        for i, track in pairs:
            reason = None
            if config.enable_persistence and track.hits < config.min_frames:
                reason = PERSISTENCE
            elif config.enable_cooldown and self._cooling(detections[i][1], ts):
                reason = COOLDOWN
            elif config.enable_cooldown:
                self.recent.append((detections[i][1], ts))
            mean = track.total / track.hits
            out[i] = (reason, track.label, track.hits, track.peak, mean, track.first_frame, track.first_ts)
        return out

    def _claim(self, box, candidates):
        best, best_iou = None, self.config.track_iou
        for track in candidates:
            overlap = box_iou(box, track.box)
            if overlap >= best_iou:
                best, best_iou = track, overlap
        return best

    def _cooling(self, box, ts) -> bool:
        limit, least = self.config.cooldown_seconds, self.config.cooldown_iou
        self.recent = [r for r in self.recent if ts - r[1] <= limit]
        for other, _ in self.recent:
            if box_iou(box, other) >= least:
                return True
        return False

    # State that outlives a task: streaming state, and the hand-over between chunks of one key.

    def live(self, next_number: int | None) -> list[Track]:
        """Tracks that the frame ``next_number`` could still claim."""
        if next_number is None:
            return list(self.tracks)
        horizon = next_number - self.config.max_misses - 1
        return [t for t in self.tracks if t.seen >= horizon]

    def cooling(self, next_ts: float) -> list[tuple]:
        """Boxes confirmed so lately that they still count at ``next_ts``."""
        return [(b, t) for b, t in self.recent if next_ts - t <= self.config.cooldown_seconds]

    def save(self) -> dict:
        return {
            "tracks": [
                [*t.box, t.seen, t.hits, t.peak, t.total, t.first_frame, t.first_ts, t.label] for t in self.tracks
            ],
            "recent": [[*b, t] for b, t in self.recent],
            "opened": self.opened,
        }

    def load(self, state: dict) -> "Cascade":
        self.tracks = [Track(tuple(t[:4]), *t[4:]) for t in state["tracks"]]
        self.recent = [(tuple(r[:4]), r[4]) for r in state["recent"]]
        self.opened = state["opened"]
        return self

    # Hand-over between chunks (see validator.py).

    def shape(self, next_number: int | None) -> dict:
        """The tracks that decide the next chunk's outcome, without identities, so that guesses can be compared."""
        enough = max(self.config.min_frames, 1)
        return {"tracks": [[*t.box, t.seen, min(t.hits, enough)] for t in self.live(next_number)]}

    def load_shape(self, shape: dict) -> "Cascade":
        """Start from a guess; carried tracks are labelled -1, -2, ... by position."""
        self.tracks = []
        for position, t in enumerate(shape["tracks"]):
            track = Track(tuple(t[:4]), t[4], t[5], float("-inf"), 0.0, None, None, -(position + 1))
            track.local_hits = 0
            self.tracks.append(track)
        return self

    def ledger(self, next_number: int | None) -> dict:
        """Identities and totals of this chunk alone, to be chained over the chunks of a key."""
        return {
            "tracks": [
                [t.label, t.local_hits, t.peak if t.local_hits else None, t.total, t.first_frame, t.first_ts]
                for t in self.live(next_number)
            ],
            "opened": self.opened,
        }


def dump(state: dict) -> str:
    return json.dumps(state, separators=(",", ":"))
