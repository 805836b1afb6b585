"""A plain model of url verdicts: rules, best splits of host labels, naive Bayes smoothed over what occurs."""

import math
import re
from collections import Counter

from lanewright.llm import url_filter


def judged(urls, texts, rules, parts):
    """urls, texts: by id; parts: (host, path) by id. Verdict, rule's verdict or None, and log odds by id."""
    count = Counter(w for t in texts.values() for w in re.split("[^a-z]+", re.sub("<[^>]*>", " ", t or "").lower()) if w)
    total = max(2, sum(count.values()))

    def split(label):
        best = [(0.0, [])]
        for end in range(1, len(label) + 1):
            options = []
            for start in range(max(0, end - url_filter.LONGEST), end):
                w = label[start:end]
                cost = math.log(total) - (math.log(count[w]) if count[w] else math.log(10) - len(w) * math.log(10))
                options.append((best[start][0] + cost, start, best[start][1] + [w]))
            cost, _, ws = min(options, key=lambda o: o[:2])
            best.append((cost, ws))
        return best[-1][1]

    bags, ruled = {}, {}
    for i in urls:
        host, path = parts[i]
        bags[i] = ["h:" + w for label in host.split(".") if label for w in split(label)]
        bags[i] += ["p:" + re.sub("[0-9]+", "0", w) for w in re.split(r"[\W_]+", path.lower()) if w]
        ruled[i] = next((v for t, v in sorted(rules, key=lambda r: -len(r[0])) if ("." + host).endswith("." + t.partition("/")[0]) and path.startswith("/" + t.partition("/")[2])), None)
    seen = {v: Counter(w for i in bags if ruled[i] == v for w in bags[i]) for v in ("allow", "block")}
    size = {v: sum(c.values()) for v, c in seen.items()}
    known, n, out = len(seen["allow"].keys() | seen["block"].keys()), Counter(ruled.values()), {}
    for i in bags:
        odds = math.log(n["block"] / n["allow"])
        for w in bags[i]:
            if seen["allow"][w] + seen["block"][w]:
                odds += math.log((seen["block"][w] + 1) / (size["block"] + known)) - math.log((seen["allow"][w] + 1) / (size["allow"] + known))
        out[i] = ruled[i] or ("block" if odds > 0 else "allow"), ruled[i], odds
    return out
