"""Fill-in-the-middle transformation: documents are cut at two token ranks and their parts put in another order."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import packed_rows, table, text_batches

#: The markers before prefix, suffix and middle. No marker has an end that is also its beginning, so the
#: first one that is found in an output is the one that was put there.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a lane for one of the lane above, on average.
STRIDE = 4
#: Units up to which no further lane is built.
TOP = 8


@dataclass
class Lane:
    """A lane of links. Link k leaves the lane's node k; the nodes are units of the text, and the first is its begin."""

    units: np.ndarray  # width of each link in units
    chars: np.ndarray  # width of each link in code points
    down: np.ndarray  # where node k stands in the lane below


class SkipList:
    """An indexable skip list over the tokens of a text: each link of a lane says how many units and code points it passes.

    A unit is a run of A-Z and a-z, or any other single code point. Whether a unit stands in the lane above depends on its
    index alone, so reruns agree.
    """

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        letter = ((points | 32) >= 97) & ((points | 32) <= 122)
        begins = ~letter
        begins[:1] = True
        begins[1:] |= letter[1:] & ~letter[:-1]
        starts = np.flatnonzero(begins)
        self.n, self.n_chars = len(starts), len(points)
        self.lanes: list[Lane] = []
        if not self.n:
            return
        nodes, at = np.arange(self.n, dtype=np.int64), starts
        down = nodes
        while True:
            self.lanes.append(Lane(np.diff(nodes, append=self.n), np.diff(at, append=self.n_chars), down))
            if len(nodes) <= TOP:
                return
            drawn = _mixed(nodes, len(self.lanes)) % np.uint64(STRIDE) == 0
            drawn[0] = True
            down = np.flatnonzero(drawn)
            nodes, at = nodes[down], at[down]

    def seek(self, rank: int) -> int:
        """The code points before unit `rank`, found from the top lane down; the rank after the last unit is the text's end."""
        units = chars = node = 0
        for lane in reversed(self.lanes):
            while node < len(lane.units) and units + lane.units[node] <= rank:
                units += int(lane.units[node])
                chars += int(lane.chars[node])
                node += 1
            if node == len(lane.units):
                return chars
            node = int(lane.down[node])
        return chars


def _mixed(index: np.ndarray, lane: int) -> np.ndarray:
    """Numbers that look drawn at random, from the index of a unit and the lane."""
    x = index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(lane)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def transformed(text: str, first: int, second: int, plain: bool, suffix_first: bool) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, output of one text; first and second are numbers that choose the cuts."""
    units = SkipList(text)
    if plain or not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return units.n, "plain", None, None, text
    low, high = sorted((first % (units.n + 1), second % (units.n + 1)))
    a, b = units.seek(low), units.seek(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if suffix_first:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def _transform(text: pd.Series, first: pd.Series, second: pd.Series, plain: pd.Series, suffix_first: pd.Series) -> pd.DataFrame:
    rows = [transformed(*r) for r in zip(text, first, second, plain, suffix_first, strict=True)]
    out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
    return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: its parts, found by the first marker of each kind, in their first order."""
    body = F.substring(output, 4, 2**31 - 1)
    cut = F.when(form == "psm", F.instr(body, SUFFIX)).otherwise(F.instr(body, PREFIX))
    first, rest = F.substring(body, F.lit(1), cut - 1), F.substring(body, cut + 3, F.lit(2**31 - 1))
    end = F.instr(rest, MIDDLE)
    second, middle = F.substring(rest, F.lit(1), end - 1), F.substring(rest, end + 3, F.lit(2**31 - 1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, suffix_first_percent: int = 20) -> DataFrame:
    """docs(doc_id, text, ...) with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output.

    The cuts are chosen by a hash of doc_id, so reruns and equal ids agree; a null id counts as empty. Null texts are
    empty, and empty texts stay plain, as do those that contain a marker. Every row is transformed by itself, repeated
    rows alike; a very long text takes about forty bytes of memory for each code point. Columns of docs with the names of
    the new ones are replaced. No row is shuffled.
    """
    text_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = packed_rows(docs, "doc_id", "text")
    made = rows.select("doc", pandas_udf(_transform, OUT)(F.coalesce("text", F.lit("")), h[0], h[1], h[2] % 100 >= 100 - plain_percent, h[3] % 100 < suffix_first_percent).alias("made"))
    names = [c.split()[0] for c in OUT.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    return made.select(*[F.col("doc")[c].alias(c) for c in kept], *[F.col("made")[c].alias(c) for c in names])


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All documents, transformed, and the texts that are rebuilt from form and output alone."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


OP13_SQL = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
c AS (SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS p, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS q,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, array_to_string(u[1:least(p, q)], '') AS a, array_to_string(u[least(p, q) + 1:greatest(p, q)], '') AS m, array_to_string(u[greatest(p, q) + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""
