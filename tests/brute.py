"""Plain sequential restatements of the semantics, kept independent of the library."""


def iou(a, b):
    ix = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    iy = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    union = area(a) + area(b) - ix * iy
    return ix * iy / union if union > 0 else 0.0


def cascade(frames, cfg):
    """frames: [(frame_index, ts, [(det_seq, conf, box)])] in order. Returns {det_seq: (reason, track, hits, peak, ff)}"""
    tracks, recent, nxt, out = [], [], 1, {}
    for index, ts, dets in frames:
        strong, weak = [], []
        for d in dets:
            if cfg.enable_confidence and d[1] < cfg.min_confidence:
                out[d[0]] = ("confidence", None, None, None, None)
                if d[1] >= cfg.association_floor:
                    weak.append(d)
            else:
                strong.append(d)
        free, pairs = list(tracks), []
        for d in sorted(strong, key=lambda d: d[1], reverse=True):
            best, best_iou = None, cfg.track_iou
            for t in free:
                v = iou(d[2], t["box"])
                if v >= best_iou:
                    best, best_iou = t, v
            if best is None:
                best = dict(id=nxt, box=d[2], hits=1, miss=0, conf=[d[1]], ff=index)
                nxt += 1
                tracks.append(best)
            else:
                free = [t for t in free if t["id"] != best["id"]]
                best.update(box=d[2], hits=best["hits"] + 1, miss=0)
                best["conf"].append(d[1])
            pairs.append((d, best))
        for t in free:
            t["miss"] += 1
        tracks = [t for t in tracks if t["miss"] <= cfg.max_misses]
        if cfg.low_confidence_association:
            cand = [t for t in tracks if t["miss"] > 0]
            for d in sorted(weak, key=lambda d: d[1], reverse=True):
                best, best_iou = None, cfg.track_iou
                for t in cand:
                    v = iou(d[2], t["box"])
                    if v >= best_iou:
                        best, best_iou = t, v
                if best is not None:
                    best.update(box=d[2], miss=0)
                    cand = [t for t in cand if t["id"] != best["id"]]
        for d, t in pairs:
            reason = None
            if cfg.enable_persistence and t["hits"] < cfg.min_frames:
                reason = "persistence"
            else:
                if cfg.enable_cooldown:
                    recent = [(b, w) for b, w in recent if ts - w <= cfg.cooldown_seconds]
                    if any(iou(d[2], b) >= cfg.cooldown_iou for b, _ in recent):
                        reason = "cooldown"
                if reason is None:
                    recent.append((d[2], ts))
            out[d[0]] = (reason, t["id"], t["hits"], max(t["conf"]), t["ff"])
    return out
