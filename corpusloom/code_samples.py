"""Source files made of the table supplier, one a row: Python for half of them, Go and C for a quarter each.

The driver's tables hold no code, so the queries on parsers and on what is built from them read these.  Every line of a file is
known from the supplier's keys, so what a parser must find can be told by SQL from the table alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import count_lines

PYTHON = '''"""Module {k}."""
import os
import requests
from pkg{n} import mod_{m}

LIMIT_{k} = {k}


class Store{k}(Base{n}):
    """Keeps {k}."""

    size: int = {k}

    def save(self, item):
        # TODO: urgent, check {k}
        return store_{k}(item)


@app.route("/items/{k}", methods=["POST"])
async def create_{k}(name: str, size: int = {n}) -> dict:
    """Creates item {k} for all. Then more."""
    if name:
        data = clean_{m}(name)
    elif size > 3:
        raise ValueError("size")
    for i in range(size):
        try:
            notify_{k}(data)
        except KeyError:
            log_error(i)
    return data


def clean_{m}(text):
    secret = text
    return store_{k}(secret)


def main():
    create_{k}("a")
'''
GO = '''// Package m{k} holds {k}.
package m{k}

import (
	"fmt"
	"example.org/lib/pkg{n}"
)

// Limit of {k}.
const Limit{k} = {k}

// Box{k} keeps things.
type Box{k} struct {
	Base{n}
	Size int
}

// Save stores v.
func (b *Box{k}) Save(v int) error {
	if v > {k} {
		return fmt.Errorf("v")
	}
	for i := 0; i < v; i++ {
		go work_{k}(i)
	}
	return nil
}

func main() {
	box := Box{k}{}
	box.Save({n})
}
'''
C = '''#include <stdio.h>
#include "own_{n}.h"

static int limit_{k} = {k};

struct pair_{k} {
    int a;
    char b[8];
};

/* Adds up to n. */
int add_{k}(int n, const char *s) {
    int sum = 0;
    do {
        sum += step_{k}(n);
        n--;
    } while (n > 0 && s);
    if (sum > {k})
        report(s, sum);
    strcpy(buf, s);
    return sum;
}
'''
SHELL = "#!/usr/bin/env python3\nprint({k})\n"
#: DuckDB: (k, n, m, kind) of each supplier, and the path and language of its file.
SQL = "SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 7 AS m, CASE s_suppkey % 4 WHEN 2 THEN 'Go' WHEN 3 THEN 'C' ELSE 'Python' END AS lang, 'src/pkg' || s_nationkey || '/mod_' || s_suppkey || CASE s_suppkey % 4 WHEN 2 THEN '.go' WHEN 3 THEN '.c' ELSE '.py' END AS path FROM supplier"


def spread(supplier: DataFrame) -> DataFrame:
    """The rows over all cores: each makes a text that is many times its size, so a table that is one split isn't one task."""
    return supplier.repartition(2 * supplier.sparkSession.sparkContext.defaultParallelism)


def filled(template: str):
    out = F.lit(template)
    for name, value in (("k", F.col("s_suppkey")), ("n", F.col("s_nationkey")), ("m", F.col("s_suppkey") % 7)):
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def files(supplier: DataFrame) -> DataFrame:
    """(path, content, lang, loc) of one source file for each supplier."""
    kind = F.col("s_suppkey") % 4
    pick = lambda go, c, python: F.when(kind == 2, go).when(kind == 3, c).otherwise(python)
    path = F.concat(F.lit("src/pkg"), F.col("s_nationkey").cast("string"), F.lit("/mod_"), F.col("s_suppkey").cast("string"), pick(F.lit(".go"), F.lit(".c"), F.lit(".py")))
    made = supplier.select(path.alias("path"), pick(filled(GO), filled(C), filled(PYTHON)).alias("content"), pick(F.lit("Go"), F.lit("C"), F.lit("Python")).alias("lang"))
    return made.withColumn("loc", count_lines(F.col("content")).cast("long"))


def others(supplier: DataFrame) -> DataFrame:
    """(path, content) of files beside them that a walk of the tree must leave out, and a script that only its first line tells."""
    k = F.col("s_suppkey").cast("string")
    each = F.array(
        *(F.struct(F.concat(F.lit(a), k, F.lit(b)).alias("path"), filled(text).alias("content")) for a, b, text in (("docs/guide_", ".py", PYTHON), ("src/gen_", ".tmp.py", PYTHON), ("node_modules/x", ".js", "const x = {k}\n"), ("src/.hidden_", ".py", PYTHON), ("notes/n_", "", "just words {k}\n"), ("bin/run_", "", SHELL)))
    )
    return supplier.select(F.explode(each).alias("f")).select("f.*")
