"""Issues of one provision: chunks of different regulations, of different days, with nearly the same text.

Grouping depends on the order of candidates, so it is done for one question at a time, over its pool of candidates (at most POOL);
questions are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.vectors import cosines

POOL, SIMILARITY, LINKAGE = 100, 0.95, "chain"


def another_issue(regulation_a: Column, date_a: Column, regulation_b: Column, date_b: Column) -> Column:
    """Of another regulation and, where both days are known, of another day."""
    return (regulation_a != regulation_b) & (date_a.isNull() | date_b.isNull() | (date_a != date_b))


class Grouping:
    """Candidates, best first: their regulations, days (None: unknown, sorts as the oldest) and cosines."""

    def __init__(self, regulations: list, days: list, similar: np.ndarray):
        self.regulations, self.days, self.similar = regulations, days, similar
        known = np.array([d is not None for d in days], bool)
        reg, day = np.array(regulations, object), np.array([d or "" for d in days], object)
        same_day = (day[:, None] == day[None, :]) & known[:, None] & known[None, :]
        self.another = (reg[:, None] != reg[None, :]) & ~same_day

    def best(self, least: float) -> list[list[int]]:
        """Each joins the first group that it is another issue of throughout and whose first member it resembles."""
        groups: list[list[int]] = []
        for i in range(len(self.days)):
            home = next((g for g in groups if self.similar[g[0], i] >= least and self.another[i, g].all()), None)
            groups.append([i]) if home is None else home.append(i)
        return groups

    def chain(self, least: float) -> list[list[int]]:
        """Links by falling similarity (then by position) join two groups, unless a regulation or day would be in the group twice."""
        n = len(self.days)
        a, b = np.triu_indices(n, 1)
        use = self.another[a, b] & (self.similar[a, b] >= least)
        a, b = a[use], b[use]
        home, groups = list(range(n)), {i: [i] for i in range(n)}
        for at in np.lexsort((b, a, -self.similar[a, b])):
            x, y = sorted((home[a[at]], home[b[at]]))
            if x == y or not self.another[np.ix_(groups[x], groups[y])].all():
                continue
            for i in groups[y]:
                home[i] = x
            groups[x] = sorted(groups[x] + groups.pop(y))
        return [groups[k] for k in sorted(groups)]

    def latest(self, members: list[int]) -> int:
        """The most recent; the best placed of several."""
        return max(members, key=lambda i: (self.days[i] or "", -i))

    def arranged(self, groups: list[list[int]], asked: list[bool]) -> list[tuple[int, list[int]]]:
        """(leader, the others, most recent first), in the order of groups; a member that states what was asked for comes on its own before
        its group if the leader doesn't."""
        out = []
        for g in groups:
            leader = self.latest(g)
            wanted = [] if asked[leader] else [i for i in g if asked[i]]
            apart = self.latest(wanted) if wanted else None
            if apart is not None:
                out.append((apart, []))
            rest = [i for i in g if i not in (leader, apart)]
            rest.sort(key=lambda i: self.days[i] or "", reverse=True)
            out.append((leader, rest))
        return out


SCHEMA = "question long, place int, chunk_id long, under long, nested int, text_similarity double"


def group_versions(candidates: DataFrame, least: float = SIMILARITY, linkage: str = LINKAGE) -> DataFrame:
    """candidates (question, chunk_id, similarity, regulation_id, enacted_on, embedding, asked) -> for each question its results in order:
    place, chunk_id, and for earlier versions the chunk they stand under, their place there and the similarity of the texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["similarity", "chunk_id"], ascending=[False, True], kind="stable")
        days = [None if pd.isna(d) else str(d)[:10] for d in pdf.enacted_on]
        vectors = np.stack([np.asarray(v, np.float64) for v in pdf.embedding])
        g = Grouping(pdf.regulation_id.tolist(), days, cosines(vectors, vectors))
        groups = g.chain(least) if linkage == "chain" else g.best(least)
        ids = pdf.chunk_id.tolist()
        rows = []
        for place, (leader, others) in enumerate(g.arranged(groups, pdf.asked.tolist())):
            rows.append((place, ids[leader], None, None, None))
            rows += [(place, ids[i], ids[leader], at, float(g.similar[leader, i])) for at, i in enumerate(others)]
        out = pd.DataFrame(rows, columns=["place", "chunk_id", "under", "nested", "text_similarity"])
        out.insert(0, "question", pdf.question.iloc[0])
        return out.astype({"under": "Int64", "nested": "Int32"})

    columns = candidates.select("question", "chunk_id", "similarity", "regulation_id", F.col("enacted_on").cast("string").alias("enacted_on"), F.col("embedding").cast("array<double>").alias("embedding"), "asked")
    return columns.groupBy("question").applyInPandas(run, SCHEMA)


def version_pairs(pool: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a, b, similarity: links between the candidates of one pool (pos, regulation_id, enacted_on, embedding). A pool has at most POOL rows."""
    from codicil.functions.vectors import cosine

    a, b = pool.alias("a"), pool.alias("b")
    col = lambda t, c: F.col(f"{t}.{c}")
    near = cosine(col("a", "embedding"), col("b", "embedding"))
    pairs = a.join(b, (col("a", "pos") < col("b", "pos")) & another_issue(col("a", "regulation_id"), col("a", "enacted_on"), col("b", "regulation_id"), col("b", "enacted_on")))
    return pairs.select(col("a", "pos").alias("a"), col("b", "pos").alias("b"), near.alias("similarity")).where(F.col("similarity") >= least)
