"""The rules applied one batch at a time, in plain Python. Test code only."""

from __future__ import annotations

from collections import defaultdict


def run(batches):
    """batches: (seq, site, [(rid, device, instant, mass)]) in arrival order.

    Returns {(seq, pos): (verdict, stored mass)}.
    """
    anonymous = {}  # (site, device, instant) -> mass
    named_at = defaultdict(list)  # (site, device, instant) -> masses, in order
    by_id = {}  # (site, device, rid) -> mass
    out = {}
    for seq, site, readings in batches:
        # The checks look at what was there before the batch.
        before_anonymous, before_named = dict(anonymous), {k: v[0] for k, v in named_at.items()}
        before_id = dict(by_id)
        inserted = set()
        for pos, (rid, device, instant, mass) in enumerate(readings):
            at, key = (site, device, instant), (site, device, rid)
            if rid is None and at in before_named:
                out[seq, pos] = ("mixed_identity", before_named[at])
            elif rid is not None and at in before_anonymous:
                out[seq, pos] = ("mixed_identity", before_anonymous[at])
            elif rid is not None and key in before_id:
                same = before_id[key] == mass
                out[seq, pos] = ("duplicate" if same else "value_conflict", before_id[key])
            elif rid is None and at in anonymous:
                same = anonymous[at] == mass or at in inserted
                out[seq, pos] = ("duplicate" if same else "value_conflict", anonymous[at])
            else:
                out[seq, pos] = ("accept", None)
                inserted.add(at)
                if rid is None:
                    anonymous[at] = mass
                else:
                    by_id[key] = mass
                    named_at[at].append(mass)
    return out


def history(rng, site, first_seq, n_batches, share_named, legacy_share=0.3):
    """A random arrival log of one site, dense enough for rules to collide."""
    batches = []
    for i in range(n_batches):
        readings, seen_ids, scheme_at = [], set(), {}
        legacy = rng.random() < legacy_share
        for _ in range(rng.randint(1, 4)):
            device, instant = f"d{rng.randint(0, 1)}", rng.randint(0, 4)
            mass = rng.randint(1, 3)
            rid = None
            if not legacy and rng.random() < share_named:
                rid = f"r{rng.randint(0, 3)}"
            identity = (device, rid) if rid else (device, "@", instant)
            if not legacy:
                # What validation would refuse never reaches the verdicts.
                if identity in seen_ids:
                    continue
                if scheme_at.setdefault((device, instant), rid is None) != (rid is None):
                    continue
            seen_ids.add(identity)
            readings.append((rid, device, instant, mass))
        if readings:
            batches.append((first_seq + i, site, readings))
    return batches
