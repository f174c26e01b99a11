"""Detection and numbering in plain Python, for comparison: written from the rules, one text at a time."""

import re

from maskloom.functions.fixed import CYRILLIC, DETECTOR_ORDER, LATIN, NORMAL_FROM, NORMAL_TO, PATTERNS


def clean(text):
    text = text.translate({ord(c): (NORMAL_TO[i] if i < len(NORMAL_TO) else None) for i, c in enumerate(NORMAL_FROM)})
    table = str.maketrans(LATIN, CYRILLIC)
    return re.sub("[A-Za-zА-Яа-яЁё]+(?:-[A-Za-zА-Яа-яЁё]+)*", lambda m: m[0].translate(table) if re.search("[А-Яа-яЁё]", m[0]) else m[0], text)


def python_pattern(p):
    flags = re.IGNORECASE if p.startswith("(?iU)") else 0
    return re.compile(re.sub(r"^\(\?i?U\)", "", p), flags)


def spans(text):
    found = []
    for kind, p, group in PATTERNS:
        for m in python_pattern(p).finditer(text):
            found.append((m[group], kind, m.start(group), m.end(group), DETECTOR_ORDER.index(kind)))
    kept = []
    for s in sorted(set(found), key=lambda s: (s[2] - s[3], s[2], s[4])):
        if all(s[3] <= k[2] or s[2] >= k[3] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[2])


def anonymise(texts):
    mapping, numbers, out = {}, {}, []
    for t in texts:
        t = clean(t)
        for value, kind, a, b, _ in sorted(spans(t), key=lambda s: -s[2]):
            key = (kind, value.strip())
            if key not in mapping:
                numbers[kind] = numbers.get(kind, 0) + 1
                mapping[key] = f"{kind}_{numbers[kind]:04d}"
            t = t[:a] + mapping[key] + t[b:]
        out.append(t)
    return out, mapping
