"""Plain-Python counterparts used to check the Spark jobs on small data."""

import math
import re
from collections import Counter

from lexmere.functions.fixed import english_stop_words

STOP = set(english_stop_words())


def terms(text):
    words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in STOP]
    return words + [" ".join(p) for p in zip(words, words[1:])]


class Corpus:
    def __init__(self, texts, min_df=2, max_df=0.95):
        self.tf = {k: Counter(terms(t)) for k, t in texts.items()}
        df = Counter(t for c in self.tf.values() for t in c)
        self.n = len(texts)
        self.df = {t: d for t, d in df.items() if min_df <= d <= max_df * self.n}
        self.dl = {
            k: sum(v for t, v in c.items() if t in self.df) for k, c in self.tf.items()
        }
        self.avgdl = sum(self.dl.values()) / self.n if self.n else 0

    def bm25(self, query, k1=1.5, b=0.75):
        out = {}
        for doc, tf in self.tf.items():
            score = 0.0
            for t in set(terms(query)) & set(self.df) & set(tf):
                idf = math.log((self.n - self.df[t] + 0.5) / (self.df[t] + 0.5) + 1)
                norm = k1 * (1 - b + b * self.dl[doc] / (self.avgdl + 1e-12))
                score += idf * tf[t] * (k1 + 1) / (tf[t] + norm + 1e-12)
            if score > 0:
                out[doc] = score
        return out

    def vector(self, counts):
        w = {
            t: v * (math.log((1 + self.n) / (1 + self.df[t])) + 1)
            for t, v in counts.items()
            if t in self.df
        }
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()} if size else {}

    def cosine(self, query):
        q = self.vector(Counter(terms(query)))
        out = {}
        for doc, tf in self.tf.items():
            d = self.vector(tf)
            score = sum(q[t] * d[t] for t in q.keys() & d.keys())
            if score > 0:
                out[doc] = score
        return out


def ranked(scores, k):
    return sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]


def mmr(query, texts, k, trade):
    """Indices of `texts` in diverse order."""
    c = Corpus({-1: query, **dict(enumerate(texts))}, min_df=1, max_df=1.0)
    vec = {i: c.vector(c.tf[i]) for i in c.tf}

    def dot(a, b):
        return round(sum(vec[a][t] * vec[b][t] for t in vec[a].keys() & vec[b].keys()), 12)

    rel = [dot(-1, i) for i in range(len(texts))]
    picks = [max(range(len(texts)), key=lambda i: (rel[i], -i))]
    while len(picks) < min(k, len(texts)):
        rest = [i for i in range(len(texts)) if i not in picks]
        gain = {
            i: round(trade * rel[i] - (1 - trade) * max(dot(i, j) for j in picks), 12) for i in rest
        }
        picks.append(max(rest, key=lambda i: (gain[i], -i)))
    return picks
