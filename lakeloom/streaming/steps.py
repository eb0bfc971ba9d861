"""Decisions over change streams that depend on earlier decisions: one step function each."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

Step = Callable[[dict, dict], tuple[dict, list[dict]]]


def contiguity(rev: str = "rev", rebase: str | None = None) -> Step:
    """delivered, duplicate, or gap with the range to fetch. The first is adopted; a gap does not advance.

    A row whose column `rebase` is true sets the baseline to its revision, forward only.
    """

    def step(state: dict, row: dict):
        r, last = int(row[rev]), state.get("last")
        if rebase and row[rebase]:
            ahead = last is None or r > last
            return ({"last": r} if ahead else state), [{"rev": r, "outcome": "rebaselined" if ahead else "ignored", "from_rev": None, "to_rev": None}]
        if last is None:
            return {"last": r}, [{"rev": r, "outcome": "adopted", "from_rev": None, "to_rev": None}]
        if r <= last:
            return state, [{"rev": r, "outcome": "duplicate", "from_rev": None, "to_rev": None}]
        if r == last + 1:
            return {"last": r}, [{"rev": r, "outcome": "delivered", "from_rev": None, "to_rev": None}]
        return state, [{"rev": r, "outcome": "gap", "from_rev": last + 1, "to_rev": r}]

    return step


def dedupe(rev: str = "rev", mark: str = "mark", window: int = 64) -> Step:
    """Forward a (revision, mark) not seen among the last `window` revisions. Older ones are forgotten and pass again."""

    def step(state: dict, row: dict):
        r, m = int(row[rev]), str(row[mark])
        revs, seen = state.get("revs", []), state.get("seen", {})
        if m in seen.get(str(r), []):
            return state, []
        if r not in revs:
            insort(revs, r)
        seen.setdefault(str(r), []).append(m)
        while len(revs) > window:
            seen.pop(str(revs.pop(0)), None)
        return {"revs": revs, "seen": seen}, [{"rev": r, "mark": m}]

    return step


def rate_limit(millis: str = "ms", rate: int = 4, window_ms: int = 60_000, base_ms: int = 1000, factor: float = 2.0, cap_ms: int = 60_000) -> Step:
    """At most `rate` acceptances within the window. A rejection takes no place, and doubles the wait told."""

    def step(state: dict, row: dict):
        now = int(row[millis])
        accepts = [t for t in state.get("accepts", []) if t > now - window_ms]
        strikes = state.get("strikes", 0) if accepts else 0
        if len(accepts) < rate:
            return {"accepts": [*accepts, now], "strikes": 0}, [{"ms": now, "accepted": True, "retry_ms": 0}]
        wait = int(min(base_ms * factor**strikes, cap_ms))
        return {"accepts": accepts, "strikes": strikes + 1}, [{"ms": now, "accepted": False, "retry_ms": wait}]

    return step


def capped(step: Step, key: str, millis: str = "ms", cap: int = 10_000, idle_ms: int = 600_000) -> Step:
    """A step for each value of `key`, on a node that holds at most `cap` of them.

    Values not touched for idle_ms are swept; beyond the cap the one touched longest ago is forgotten.
    """

    def whole(state: dict, row: dict):
        held, now, name = state.get("held", {}), int(row[millis]), str(row[key])  # in order of touch
        while held and next(iter(held.values()))[0] < now - idle_ms:
            held.pop(next(iter(held)))
        own, made = step(held.pop(name, [now, {}])[1], row)
        held[name] = [now, own]
        if len(held) > cap:
            held.pop(next(iter(held)))
        return {"held": held}, [{key: row[key], **m} for m in made]

    return whole


def hysteresis(millis: str = "ms", count: str = "n", bucket: str | None = None, tier: str | None = None, children: str | None = None, up: int = 64, fast_up: int = 32, overload: int = 6, down: int = 16, sticky_ms: int = 60_000, low_ms: int = 300_000, window_ms: int = 10_000, lookahead_ms: int = 30_000) -> Step:
    """Promote on count, on overload, or on the trend of the last window; demote after a long low spell."""

    def step(state: dict, row: dict):
        now, n = int(row[millis]), int(row[count])
        samples = [s for s in state.get("samples", []) if s[0] >= now - window_ms] + [[now, n]]
        low = state.get("low") if n <= down else None
        low = now if n <= down and low is None else low
        promoted, since = state.get("promoted", False), state.get("since")
        span = samples[-1][0] - samples[0][0]
        slope = (samples[-1][1] - samples[0][1]) / span if span > 0 else 0.0
        event = None
        if not promoted and (n >= up or (bucket and row[bucket] >= overload and n >= fast_up) or (slope > 0 and n + slope * lookahead_ms >= up)):
            promoted, since, event = True, now, "promote"
        elif promoted and (tier is None or row[tier] > 0) and now - since >= sticky_ms and not (children and row[children] > 0) and low is not None and now - low >= low_ms:
            promoted, since, low, event = False, None, None, "demote"
        state = {"samples": samples, "low": low, "promoted": promoted, "since": since}
        return state, [{"ms": now, "event": event}] if event else []

    return step


def bounded_queue(item: str = "item", drain: str = "drain", depth: int = 32) -> Step:
    """Arrivals queue up to depth, the oldest falling out; a row with drain > 0 takes that many from the front."""

    def step(state: dict, row: dict):
        queue, out = list(state.get("queue", [])), []
        n = int(row[drain])
        if n:
            out += [{"item": x, "outcome": "delivered"} for x in queue[:n]]
            queue = queue[n:]
        else:
            queue.append(row[item])
            if len(queue) > depth:
                out.append({"item": queue.pop(0), "outcome": "dropped"})
        return {"queue": queue}, out

    return step


def replay_ring(rev: str = "rev", payload: str = "payload", received: str = "ms", window: int = 256) -> Step:
    """Keep the highest `window` revisions, the later receipt of each; tells what retires from the ring."""

    def step(state: dict, row: dict):
        ring, r = state.get("ring", {}), str(int(row[rev]))
        if r not in ring or int(row[received]) > ring[r][1]:
            ring[r] = [row[payload], int(row[received])]
        out = []
        while len(ring) > window:
            low = min(ring, key=int)
            out.append({"rev": int(low), "payload": ring.pop(low)[0]})
        return {"ring": ring}, out

    return step


def forwarder(rev: str = "rev", mark: str = "mark", window: int = 64) -> Step:
    """Dedupe, then the greatest revision so far: what passes on, and whether it advances."""
    first = dedupe(rev, mark, window)

    def step(state: dict, row: dict):
        inner, made = first(state.get("dedupe", {}), row)
        top = state.get("top", -1)
        out = [{**m, "advances": m["rev"] > top} for m in made]
        return {"dedupe": inner, "top": max([top, *(m["rev"] for m in made)])}, out

    return step


def resident(key_seen: str = "topic", participants: str = "n", cap: int = 2048) -> Step:
    """Admit topics up to cap; when full, the least recently touched one without participants leaves, else the new one is refused."""

    def step(state: dict, row: dict):
        held = state.get("held", {})  # in order of touch
        topic, n = str(row[key_seen]), int(row[participants])
        if topic in held:
            held.pop(topic)
            held[topic] = n
            return {"held": held}, [{"topic": topic, "outcome": "resident", "evicted": None}]
        gone = None
        if len(held) >= cap:
            gone = next((t for t, k in held.items() if k == 0), None)
            if gone is None:
                return {"held": held}, [{"topic": topic, "outcome": "refused", "evicted": None}]
            held.pop(gone)
        held[topic] = n
        return {"held": held}, [{"topic": topic, "outcome": "admitted", "evicted": gone}]

    return step
