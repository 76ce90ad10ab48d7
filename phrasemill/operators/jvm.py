"""The selective parser and its decoder as functions of the JVM: the program of ``parsers.selective_columns`` and
``parsers.selected`` in Java, phrase for phrase, where Python takes too long for large tables. Spark brings the
compiler (Janino, which compiles its own plans); the classes go to the executors as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_NODES, MOST_FREQ = 1 << 13, 1 << 16  # tables are that large; beyond, the programs in Python do it
_ready: dict[str, dict] = {}

SUMMARY = """
package phrasemill.jvm;

/** PrefixSummary with its Counters: linked nodes of a level are a list in the order in which they came. */
public class Summary {
    final int k, cap;
    final int[] child, parent, label, degree, where, next, prev, first, last;
    int[] freq;
    int threshold;

    Summary(int nodes, int maxFreq) {
        k = Math.max(2, nodes - 1);
        cap = Math.max(2, maxFreq - 1);
        child = new int[k << 8];
        parent = new int[k]; label = new int[k]; degree = new int[k]; where = new int[k];
        next = new int[k]; prev = new int[k]; freq = new int[k];
        first = new int[cap + 1]; last = new int[cap + 1];
        java.util.Arrays.fill(parent, -1);
        reset();
    }

    void reset() {
        for (int v = 1; v < k; v++) if (parent[v] >= 0) child[parent[v] << 8 | label[v]] = 0;
        java.util.Arrays.fill(parent, -1);
        java.util.Arrays.fill(degree, 0);
        java.util.Arrays.fill(freq, 0);
        java.util.Arrays.fill(where, -1);
        java.util.Arrays.fill(first, 0);
        java.util.Arrays.fill(last, 0);
        threshold = 0;
        for (int v = 1; v < k; v++) link(v, 0);
    }

    void link(int v, int level) {
        where[v] = level;
        next[v] = 0;
        prev[v] = last[level];
        if (last[level] == 0) first[level] = v; else next[last[level]] = v;
        last[level] = v;
    }

    void unlink(int v) {
        int level = where[v];
        if (prev[v] == 0) first[level] = next[v]; else next[prev[v]] = next[v];
        if (next[v] == 0) last[level] = prev[v]; else prev[next[v]] = prev[v];
        where[v] = -1;
    }

    void decrementAll() {
        threshold++;
        if (threshold * 2 < cap) return;
        int[] order = new int[k];
        int n = 0;
        for (int level = 0; level <= cap; level++) for (int v = first[level]; v != 0; v = next[v]) order[n++] = v;
        for (int v = 0; v < k; v++) freq[v] = (Math.max(freq[v], threshold) - threshold) / 2;
        threshold = 0;
        java.util.Arrays.fill(first, 0);
        java.util.Arrays.fill(last, 0);
        for (int i = 0; i < n; i++) link(order[i], freq[order[i]]);
    }

    void feed(byte[] data, int at, int end) {
        int node = 0, missing = -1;
        for (int i = at; i < end; i++) {
            int c = data[i] & 255, nxt = child[node << 8 | c];
            if (nxt == 0) { missing = c; break; }
            int f = Math.max(freq[nxt], threshold);
            if (f < cap) freq[nxt] = f + 1;
            node = nxt;
        }
        if (where[node] >= 0 && where[node] != freq[node]) { unlink(node); link(node, freq[node]); }
        if (missing < 0) return;
        int v = last[threshold];
        if (v == 0 || v == node) { decrementAll(); return; }
        unlink(v);
        int old = parent[v];
        if (old >= 0) {
            child[old << 8 | label[v]] = 0;
            if (--degree[old] == 0 && old != 0) link(old, Math.max(freq[old], threshold));
        }
        if (degree[node] == 0 && node != 0) unlink(node);
        parent[v] = node;
        label[v] = missing;
        child[node << 8 | missing] = v;
        degree[node]++;
        freq[v] = threshold + 1;
        link(v, threshold + 1);
    }
}
"""

#: A function of (bytes, k, window, max_freq) that keeps its summary's tables from row to row.
_FUNCTION = """
public class %s implements org.apache.spark.sql.api.java.UDF4 {
    private transient Summary top;
    private transient int nodes, freqs;

    public Object call(Object bytes, Object k, Object window, Object maxFreq) {
        int n = ((Integer) k).intValue(), m = ((Integer) maxFreq).intValue();
        if (top == null || nodes != n || freqs != m) { top = new Summary(n, m); nodes = n; freqs = m; } else top.reset();
        return run((byte[]) bytes, ((Integer) window).intValue());
    }
%s}
"""

#: A phrase is four bytes: a node's number, or -1 minus the literal.
ENCODE = _FUNCTION % ("Encode", """
    private byte[] run(byte[] data, int window) {
        java.io.ByteArrayOutputStream out = new java.io.ByteArrayOutputStream(data.length * 2 + 16);
        int at = 0, fed = 0;
        while (at < data.length) {
            int node = 0, depth = 0, end = Math.min(data.length, at + window);
            while (at + depth < end) {
                int nxt = top.child[node << 8 | data[at + depth] & 255];
                if (nxt == 0) break;
                node = nxt;
                depth++;
            }
            int phrase = depth > 1 ? node : -1 - (data[at] & 255);
            for (int shift = 24; shift >= 0; shift -= 8) out.write(phrase >> shift);
            at += depth > 1 ? depth : 1;
            for (; fed + window <= at; fed++) top.feed(data, fed, fed + window);
        }
        return out.toByteArray();
    }
""")

DECODE = _FUNCTION % ("Decode", """
    private byte[] run(byte[] packed, int window) {
        java.nio.ByteBuffer phrases = java.nio.ByteBuffer.wrap(packed);
        byte[] out = new byte[packed.length + 16];
        int size = 0, fed = 0;
        while (phrases.hasRemaining()) {
            int phrase = phrases.getInt(), depth = phrase < 0 ? 1 : 0;
            for (int v = phrase; v > 0; v = top.parent[v]) depth++;
            if (size + depth > out.length) out = java.util.Arrays.copyOf(out, Math.max(size + depth, 2 * size));
            if (phrase < 0) out[size] = (byte) (-1 - phrase);
            int place = size + depth;
            for (int v = phrase; v > 0; v = top.parent[v]) out[--place] = (byte) top.label[v];
            size += depth;
            for (; fed + window <= size; fed++) top.feed(out, fed, fed + window);
        }
        return java.util.Arrays.copyOf(out, size);
    }
""")


def fits(k: int = 1024, window: int = 8, max_freq: int = 1024) -> bool:
    return k <= MOST_NODES and max_freq <= MOST_FREQ and window > 0


def register(spark: SparkSession) -> None:
    """Compile the functions and send them to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _ready:
        java = spark._jvm
        compiler = java.org.codehaus.janino.SimpleCompiler()
        compiler.cook("phrasemill", java.java.io.StringReader(SUMMARY + ENCODE + DECODE))
        handle, path = tempfile.mkstemp(suffix=".jar", prefix="phrasemill-")
        os.close(handle)
        compiled = compiler.getBytecodes()
        with zipfile.ZipFile(path, "w") as jar:
            for name in compiled:
                jar.writestr(name.replace(".", "/") + ".class", bytes(compiled[name]))
        spark.sparkContext._jsc.addJar(os.path.realpath(path))
        loader, none = compiler.getClassLoader(), spark.sparkContext._gateway.new_array(java.java.lang.Class, 0)
        _ready[app] = {name: loader.loadClass(f"phrasemill.jvm.{name}").getDeclaredConstructor(none) for name in ("Encode", "Decode")}
    binary = spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType
    for name, made in _ready[app].items():
        none = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 0)
        spark._jsparkSession.udf().register(f"phrasemill_selective_{name.lower()}", made.newInstance(none), binary)


def _call(name: str, column: Column, k: int = 1024, window: int = 8, max_freq: int = 1024) -> Column:
    return F.call_function(f"phrasemill_selective_{name}", column, F.lit(k), F.lit(window), F.lit(max_freq))


def selective_parse(rows: DataFrame, column: str = "b", **options: int) -> DataFrame:
    """rows with the binary column replaced by ``packed``: phrases of four bytes. A null parses as empty."""
    register(rows.sparkSession)
    return rows.select(*(c for c in rows.columns if c != column), _call("encode", F.coalesce(column, F.lit(b"")), **options).alias("packed"))


def selective_decode(parsed: DataFrame, **options: int) -> DataFrame:
    """The inverse of selective_parse, from the phrases alone: ``packed`` replaced by the binary column ``b``."""
    register(parsed.sparkSession)
    return parsed.select(*(c for c in parsed.columns if c != "packed"), _call("decode", F.col("packed"), **options).alias("b"))
