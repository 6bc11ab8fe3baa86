"""Language identification by output codes as it is defined, in loops."""

import zlib
from collections import Counter, defaultdict

import numpy as np


def plain_model(taught):
    """Counts, codewords and weights by their definitions, in plain Python.

    The result decodes a text to language, score, distance and size class.
    """

    def grams(text):
        line, letter_before = " ", False
        for char in text.lower():
            if char.isalpha():
                line += char
            elif letter_before:
                line += " "
            letter_before = char.isalpha()
        if not any(c.isalpha() for c in line):
            return None
        found = Counter()
        mixed = [0] * len(line)
        for n in range(3):
            if n < len(line):
                mixed = [(m * 2654435761 + ord(line[i + n]) * (2654435761, 2246822519, 3266489917)[n]) % 2**32 for i, m in enumerate(mixed[: len(line) - n])]
                mixed = [m ^ m >> 15 for m in mixed]
                found.update(m * 2246822519 % 2**32 >> 18 for m in mixed)
        return found

    counts = defaultdict(Counter)
    for text, lang in taught:
        found = grams(text or "")
        if lang is not None and found:
            counts[lang] += found
    langs = sorted(counts)
    buckets = 1 << 14
    shares = {x: [(counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * buckets) for b in range(buckets)] for x in langs}
    code = {x: [1 if split >> i & 1 else -1 for split in range(1, 1 << len(langs) - 1)] for i, x in enumerate(langs)}
    bits = range(len(next(iter(code.values()))))
    weights = []
    for bit in bits:
        sides = [[shares[x] for x in langs if code[x][bit] == side] for side in (1, -1)]
        weights.append([np.log(np.mean(up)) - np.log(np.mean(down)) for up, down in zip(zip(*sides[0]), zip(*sides[1]))])
    margins = {x: [code[x][bit] * sum(s * w for s, w in zip(shares[x], weights[bit])) for bit in bits] for x in langs}
    scale = [np.mean([abs(margins[x][bit]) for x in langs]) for bit in bits]

    def decode(text):
        found = grams(text or "")
        if not found:
            return "und", 0.0, 0.0, 0
        total = sum(found.values())
        evidence = [sum(n * weights[bit][b] for b, n in found.items()) / total / scale[bit] for bit in bits]
        distances = {x: sum(max(margins[x][bit], 1e-9) * np.exp(-code[x][bit] * evidence[bit]) for bit in bits) / sum(max(m, 1e-9) for m in margins[x]) for x in langs}
        nearest = min(distances.values())
        best = min(langs, key=lambda x: distances[x])
        return best, 1 / sum(np.exp(-4 * (d - nearest) / nearest) for d in distances.values()), nearest, total.bit_length()

    signed = {x: [code[x][bit] * margins[x][bit] / scale[bit] for bit in bits] for x in langs}

    def mixed():
        most = 0.0
        for one in langs:
            for other in langs:
                if one < other:
                    evidence = [(a + b) / 2 for a, b in zip(signed[one], signed[other])]
                    most = max(most, min(sum(max(margins[x][bit], 1e-9) * np.exp(-code[x][bit] * evidence[bit]) for bit in bits) / sum(max(m, 1e-9) for m in margins[x]) for x in langs))
        return most

    decode.mixed = mixed
    return decode


def plain_kept(docs, held=None):
    """The keys of (key, text, label) rows that the language stage keeps."""
    held = held or [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs]
    taught = [(t, x) for (_, t, x), out in zip(docs, held) if not out and x is not None]
    decode = plain_model(taught)
    seen = defaultdict(list)
    for text, _ in taught:
        lang, _, distance, size = decode(text)
        if lang != "und":
            seen[lang].append((size, distance))
    kept, least = set(), decode.mixed()
    for i, text, _ in docs:
        lang, _, distance, size = decode(text)
        if lang == "und":
            continue
        sizes = [s for s, _ in seen[lang]]
        reach = max((d for s, d in seen[lang] if s >= min(size, max(sizes, default=0))), default=0.0)
        if size <= 7 or distance <= max(1.25 * reach, least):
            kept.add(i)
    return kept
