"""A small repository of several languages."""

from pyspark.sql import functions as F

from lodestone.functions.text import language_of

APP = '''import os
import sys as system
from json import loads, dumps as d
from lib import helper

def f(a, b):
    x = 1
    y = a
    while a > 0:
        a = a - 1
        if b:
            continue
        z = a
    return z
    print("never")

class K:
    def go(self):
        q = input()
        r = q
        os.system(r)
        return f(1, 2)
'''
LIB = '''from app import f

def helper(n):
    total = 0
    for i in range(n):
        total += i
    return total

def _hidden():
    return helper(3)
'''
MAIN_RS = '''use crate::util::twice;
/// Entry.
pub fn main() {
    twice(1);
    Point::new(2);
}
struct Point { x: i32 }
impl Point {
    fn new(x: i32) -> Point { Point { x } }
}
'''
FILES = [
    ("demo", "src/app.py", APP), ("demo", "src/lib.py", LIB), ("demo", "src/main.rs", MAIN_RS), ("demo", "src/util.rs", "pub fn twice(a: i32) -> i32 { a * 2 }\npub fn spare() {}\n"), ("demo", "tests/test_app.py", "from app import f\n\ndef test_f():\n    assert f(1, 0) == 0\n"),
    ("demo", "package.json", '{"dependencies": {"lodash": "^4.17.20", "axios": "1.7.0"}, "devDependencies": {"x": "1.0.0"}}'), ("demo", "requirements.txt", "# pins\nrequests==2.30.0\nflask\n-e .\n"), ("demo", "go.mod", "module m\n\nrequire (\n\tgolang.org/x/net v0.1.0\n)\nrequire a/b v1.2.3\n"), ("demo", ".env", "KEY=1"),
]


def repo(spark):
    raw = spark.createDataFrame(FILES, "repo string, path string, content string")
    return raw.withColumn("language", language_of(F.col("path")))
