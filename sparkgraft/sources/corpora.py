"""Code corpora derived from tables: one module per row, its text built by column expressions.

A row's key becomes a text a hundred times as long, so a table that Spark reads in one piece is
dealt out by key before: the texts, and the scan of them, lie in parts of DEALT rows on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed value: rows of a part, some seconds of scanning.
DEALT = 2048


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The keys alone, in parts of about DEALT rows; a number of parts that is given isn't made fewer by adaptive execution."""
    return rows.select(key).repartition(max(1, -(-rows.count() // DEALT)), key)


def fill(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns."""
    parts: list[Column] = []
    for piece in template.split("{{"):
        if "}}" in piece:
            name, rest = piece.split("}}", 1)
            parts += [values[name].cast("string"), F.lit(rest)]
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


RUST_HEAD = """//! Catalogue entry {{n}}; see ix://shop/parts/NFR-002.
use crate::shelf{{q}}::item{{m}}::Item{{m}};

pub enum Grade{{n}} {
    Plain,
    Fine,
}

pub trait Priced{{n}} {
    fn price_{{n}}(&self) -> u64;
}

pub struct Item{{n}} {
    grade: Grade{{n}},
    spare: Option<Item{{m}}>,
}

impl Priced{{n}} for Item{{n}} {
    // StR-{{t}} sets it.
    fn price_{{n}}(&self) -> u64 {
        match self.grade {
            Grade{{n}}::Plain => {{n}},
            Grade{{n}}::Fine => 2 * {{n}},
        }
    }
}

impl Item{{n}} {
    pub fn total_{{n}}(&self, count: u64) -> u64 {
        count * self.price_{{n}}()
    }
"""
RUST_STEP = """
    // Step {{k}} of FR-014.
    fn step_{{n}}_{{k}}(&self, by: u64) -> u64 {
        self.total_{{n}}(by + {{k}})
    }
"""
RUST_TAIL = """}

pub fn order_{{n}}(item: &Item{{n}}) -> u64 {
    item.total_{{n}}(1) + item.step_{{n}}_0(2)
}
"""
PYTHON = '''"""Supplier {{n}}."""
from .base import Base


class Supplier{{n}}(Base):
    # Implements StR-{{n}}.
    def ship(self):
        return self.pack_{{n}}()

    def pack_{{n}}(self):
        return 1


def main_{{n}}(s: Supplier{{n}}):
    t = s
    t.ship()
    t.missing_{{n}}()
'''
TYPESCRIPT = """import { Customer{{m}} } from './c{{m}}';

/** Customer {{n}}, see ix://shop/web/NFR-007. */
export class Customer{{n}} {
  next: Customer{{m}};
  name{{n}}(): string { return "x"; }
  show{{n}}(): string { return this.name{{n}}(); }
}

export const open{{n}} = (c: Customer{{n}}): string => {
  const d = new Customer{{n}}();
  return c.show{{n}}() + d.name{{n}}();
};
"""


TSX = """import { Row{{m}} } from './v{{m}}';

const quoted{{n}} = /[("'`]/g;

export class View{{n}} {
  label{{n}}(): string { return `a ${quoted{{n}}.test(`b(${1}`) ? "}" : "{"} c`; }
  all{{n}}(): string { return this.label{{n}}(); }
}

export function Row{{n}}(v: View{{n}}) {
  // Shows FR-{{t}}.
  return <li title="don't (">It's {v.all{{n}}()} <b>isn't {[1, 2].map(() => <i key={v.label{{n}}()}>:(</i>)}</b></li>;
}
"""


HEIRS = """import { Base{{m}} } from './b{{m}}';
export class Base{{n}} extends Base{{m}} implements Shown{{n}} {
  next: Base{{m}};
  same(): void {}
  make{{n}}(): Base{{m}} { return this.next; }
}
interface Shown{{n}} { shown{{n}}(): void; }
const helper{{n}} = function (b: Base{{n}}) { return wrap{{n}}<string>(b); };
const wrap{{n}} = x => x;
export const use{{n}} = (b: Base{{n}}) => {
  const c = b.make{{n}}();
  c.make{{m}}();
  q.same();
};
// TC-{{t}} holds.
function test_{{n}}() {}
"""


def heirs_corpus(customer: DataFrame) -> DataFrame:
    """Classes that extend the next file's, functions as values, and a method that every file declares."""
    n = F.col("c_custkey")
    return dealt(customer, "c_custkey").select(F.lit("shop").alias("org"), F.lit("heir").alias("repo"), fill("ui/b{{n}}.ts", n=n).alias("path"), F.lit("typescript").alias("language"), fill(HEIRS, n=n, m=n + 1, t=n % 7 + 1).alias("content"))


def rust_corpus(part: DataFrame, steps: int = 4) -> DataFrame:
    """36 + 5 * steps lines a file."""
    n = F.col("p_partkey")
    given = {"n": n, "m": n + 1, "q": F.floor((n + 1) / 100).cast("long"), "t": n % 7 + 1}
    content = F.concat(fill(RUST_HEAD, **given), *(fill(RUST_STEP, n=n, k=F.lit(k)) for k in range(steps)), fill(RUST_TAIL, **given))
    return dealt(part, "p_partkey").select(F.lit("shop").alias("org"), F.lit("parts").alias("repo"), fill("src/shelf{{p}}/item{{n}}.rs", p=F.floor(n / 100).cast("long"), n=n).alias("path"), F.lit("rust").alias("language"), content.alias("content"))


def python_corpus(supplier: DataFrame) -> DataFrame:
    n = F.col("s_suppkey")
    return dealt(supplier, "s_suppkey").select(F.lit("shop").alias("org"), F.lit("supply").alias("repo"), fill("tool/s{{n}}.py", n=n).alias("path"), F.lit("python").alias("language"), fill(PYTHON, n=n).alias("content"))


def typescript_corpus(customer: DataFrame) -> DataFrame:
    n = F.col("c_custkey")
    return dealt(customer, "c_custkey").select(F.lit("shop").alias("org"), F.lit("web").alias("repo"), fill("ui/c{{n}}.ts", n=n).alias("path"), F.lit("typescript").alias("language"), fill(TYPESCRIPT, n=n, m=n + 1).alias("content"))


def tsx_corpus(customer: DataFrame) -> DataFrame:
    n = F.col("c_custkey")
    return dealt(customer, "c_custkey").select(F.lit("shop").alias("org"), F.lit("view").alias("repo"), fill("ui/v{{n}}.tsx", n=n).alias("path"), F.lit("tsx").alias("language"), fill(TSX, n=n, m=n + 1, t=n % 7 + 1).alias("content"))
