"""The whole fold build against loops over lists: sides, caps, thinning, clusters, validation, settling, far from test."""

import hashlib
import random

import numpy as np
import pytest

from foldsmith.operators import splits

SCHEMA = "id long, dataset string, group_id long, subscene_id long, sha string, file string, n_boxes int, n_classes int, area double, embedding array<double>"


def made(seed, n=420, groups=60, spread=0.35):
    rnd, rng = random.Random(seed), np.random.default_rng(seed)
    centres = rng.normal(size=(groups // 2, 5))
    rows = []
    for i in range(n):
        g = rnd.randrange(groups)
        v = centres[g % len(centres)] + rng.normal(size=5) * spread
        v = (v / np.linalg.norm(v)).tolist() if i % 37 else None
        ds = "abcd"[g % 4] if rnd.random() < 0.75 else rnd.choice("abcde")
        rows.append(dict(id=i, dataset=ds, group_id=g, subscene_id=g * 3 + rnd.randrange(3), sha=f"s{rnd.randrange(n)}", file=f"f{i}", n_boxes=rnd.randrange(5), n_classes=rnd.randrange(3), area=float(rnd.randrange(50)), embedding=v))
    return rows


def near(a, b, t):
    return a["embedding"] is not None and b["embedding"] is not None and a["id"] != b["id"] and float(np.dot(a["embedding"], b["embedding"])) >= t


def in_order(rows):
    return sorted(rows, key=lambda r: (not r["n_boxes"] > 0, -r["n_classes"], -r["n_boxes"], -r["area"], r["id"]))


def keep(rows, cap, thin):
    out = []
    for r in in_order(rows):
        if any(r["sha"] == o["sha"] for o in out) or sum(r["cap"] == o["cap"] for o in out) >= cap:
            continue
        if thin is not None and any(r["embedding"] is not None and o["embedding"] is not None and np.dot(r["embedding"], o["embedding"]) >= thin for o in out):
            continue
        out.append(r)
    return out


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r["group_id"], []).append(r)
    return out


def validation(groups, train, val, boxes, ok, order, rules):
    """train, val: group -> dataset -> images; boxes: group -> class -> boxes."""
    chosen, total = [], lambda side, d, gs: sum(side.get(g, {}).get(d, 0) for g in gs)
    main = {g: max(sorted(val.get(g, {}) or {"": 0}), key=lambda d: val.get(g, {}).get(d, 0)) for g in groups}

    def share(d, gs):
        v = total(val, d, gs)
        return v / max(1, total(train, d, [g for g in groups if g not in gs]) + v)

    def fits(g):
        return share(main[g], [*chosen, g]) <= rules.most_share * rules.val_fraction

    queue = [g for g in order if ok[g] and sum(val.get(g, {}).values()) > 0]
    classes = {c for g in groups for c, n in boxes.get(g, {}).items() if n > 0}
    while True:
        have = {c: (sum(boxes.get(g, {}).get(c, 0) for g in chosen), sum(boxes.get(g, {}).get(c, 0) > 0 for g in chosen)) for c in classes}
        short = [c for c in classes if have[c][0] < rules.least_boxes or have[c][1] < rules.least_groups]
        if not short:
            break
        c = min(short, key=lambda c: (min(have[c][0] / rules.least_boxes, have[c][1] / rules.least_groups), c))
        found = next((g for g in queue if g not in chosen and boxes.get(g, {}).get(c, 0) > 0 and fits(g)), None)
        if found is None:
            classes.discard(c)
        else:
            chosen.append(found)
    for d in sorted({main[g] for g in queue}):
        for g in queue:
            if share(d, chosen) >= rules.val_fraction:
                break
            if main[g] == d and g not in chosen and fits(g):
                chosen.append(g)
    return set(chosen)


def brute(images, held_out, rules, boxes, drops, barred):
    together = {d for s in rules.keep_together for d in s}
    for r in images:
        r["cap"] = f"{r['subscene_id']}/{r['dataset']}" if r["dataset"] in together else str(r["subscene_id"])
    result = set()
    for h in held_out:
        out = {d for s in rules.hold_out_together if h in s for d in s} - {h}
        side = {g: "test" if any(r["dataset"] == h for r in rs) else "out" if any(r["dataset"] in out for r in rs) else "train" for g, rs in by_group(images).items()}
        own = [r for r in images if r["n_boxes"] > 0]
        test = [x for rs in by_group([r for r in own if side[r["group_id"]] == "test" and r["dataset"] == h]).values() for x in keep(rs, rules.eval_cap, rules.thin)]
        pool, scenes = [], {}
        for r in [r for r in own if side[r["group_id"]] == "train"]:
            scenes.setdefault(r["subscene_id"], []).append(r)
        for rs in scenes.values():
            best = in_order(rs)[0]["dataset"]
            pool += [r for r in rs if r["dataset"] == best or any(r["dataset"] in s and best in s for s in rules.keep_together)]
        as_train = [x for rs in by_group(pool).values() for x in keep(rs, rules.train_cap, rules.thin)]
        as_val = [x for rs in by_group(pool).values() for x in keep(rs, rules.eval_cap, rules.thin)]
        both = list({r["id"]: r for r in as_train + as_val}.values())
        root = {r["group_id"]: r["group_id"] for r in both}
        moved = True
        while moved:
            moved = False
            for a in both:
                for b in both:
                    if near(a, b, rules.near) and root[a["group_id"]] != root[b["group_id"]]:
                        lo, hi = sorted((root[a["group_id"]], root[b["group_id"]]))
                        root = {g: lo if x == hi else x for g, x in root.items()}
                        moved = True
        bad = {root[r["group_id"]] for r in both if (h, r["file"]) in barred}
        ok = {g: sum(x == c for x in root.values()) == 1 and c not in bad for g, c in root.items()}
        count = lambda rows: {g: {d: sum(r["dataset"] == d for r in rs) for d in {r["dataset"] for r in rs}} for g, rs in by_group([r for r in rows if (h, r["file"]) not in drops]).items()}
        train, val = count(as_train), count(as_val)
        cls = {}
        for r in [r for r in as_val if (h, r["file"]) not in drops]:
            for c, n in boxes.get(r["id"], {}).items():
                cls.setdefault(r["group_id"], {}).setdefault(c, 0)
                cls[r["group_id"]][c] += n
        groups = sorted({*train, *val})
        order = sorted(groups, key=lambda g: hashlib.sha1(f"{rules.seed}:{h}:{g}".encode()).hexdigest())
        to_val = validation(groups, train, val, cls, ok, order, rules)
        while True:
            v, t = [r for r in as_val if r["group_id"] in to_val], [r for r in as_train if r["group_id"] not in to_val]
            close = {a["group_id"] for a in v if any(near(a, b, rules.near) for b in t)}
            if not close:
                break
            to_val -= close
        t = [a for a in t if not any(near(a, b, rules.near) for b in test)]
        result |= {(h, "train", r["id"]) for r in t if (h, r["file"]) not in drops} | {(h, "val", r["id"]) for r in v if (h, r["file"]) not in drops} | {(h, "test", r["id"]) for r in test}
    return result


@pytest.mark.parametrize("seed,near_at,thin", [(1, 0.97, 0.995), (2, 0.995, None), (3, 0.9, 0.97)])
def test_build_folds(spark, seed, near_at, thin):
    rnd, rows = random.Random(seed), made(seed)
    rules = splits.FoldRules(train_cap=3, eval_cap=2, thin=thin, near=near_at, val_fraction=0.2, least_boxes=6, least_groups=2, hold_out_together=[["a", "e"]], keep_together=[["c", "d"]])
    boxes = {r["id"]: {c: rnd.randrange(3) for c in range(4) if rnd.random() < 0.5} for r in rows}
    drops = {("a", f"f{i}") for i in range(0, 420, 29)} | {("b", f"f{i}") for i in range(0, 420, 31)}
    barred = {("a", f"f{i}") for i in range(0, 420, 83)}
    frame = lambda x, ddl: spark.createDataFrame(sorted(x), ddl)
    got = splits.build_folds(
        spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3), ["a", "b"], rules,
        frame([(i, c, n) for i, m in boxes.items() for c, n in m.items()], "id long, class_id int, n long"), frame(drops, "held string, file string"), frame(barred, "held string, file string"),
    ).collect()
    want = brute(rows, ["a", "b"], rules, boxes, drops, barred)
    assert {(r.held, r.split, r.id) for r in got} == want and len(got) == len(want)
    assert {s for _, s, _ in want} == {"train", "val", "test"}
