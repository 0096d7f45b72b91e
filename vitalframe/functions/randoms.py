"""Deterministic random numbers from hashes of row keys.

``rand()`` depends on partition layout and task retries; these do not: the
same keys give the same number on any cluster, after any executor loss.

* default: the top 53 bits of Spark's ``xxhash64(keys..., seed, stream)``
  (whole-stage codegen, no strings built; ~50x faster than md5 of a key
  string, which matters at 10^11 draws).
* ``portable=True``: the first 32 bits of ``md5('k1|k2|...|seed')`` / 2^32,
  reproducible in any SQL engine with md5 (see :func:`sql_uniform`); used to
  check random operators against an independent engine.
Only integer and string keys are hashed.
"""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO32 = 4294967296.0
_EPS = 2.0 ** -33


def _key(cols, seed, stream):
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    parts = [p.cast("string") for p in parts]
    parts.append(F.lit(str(seed)))
    if stream is not None:
        parts.append(F.lit(str(stream)))
    return F.concat_ws("|", *parts)


TWO53 = 9007199254740992.0


def hash_uniform(*cols, seed: int = 0, stream: int | None = None,
                 portable: bool = False) -> Column:
    """U[0,1) from the keys; ``stream`` picks an independent sequence."""
    if portable:
        h = F.conv(F.substring(F.md5(_key(cols, seed, stream)), 1, 8), 16, 10)
        return h.cast("double") / F.lit(TWO32)
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    parts += [F.lit(int(seed)), F.lit(-1 if stream is None else int(stream))]
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return bits.cast("double") / F.lit(TWO53)


def hash_normal(*cols, seed: int = 0, stream: int = 0, portable: bool = False) -> Column:
    """Standard normal by Box-Muller on two hash uniforms."""
    u1 = hash_uniform(*cols, seed=seed, stream=2 * stream + 1, portable=portable) + F.lit(_EPS)
    u2 = hash_uniform(*cols, seed=seed, stream=2 * stream + 2, portable=portable)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# Mean of one inverse-CDF piece: exp(-mean) stays far above underflow.
_POISSON_PIECE = 256.0


def hash_poisson(lam: Column | float, *cols, seed: int = 0) -> Column:
    """Poisson draw by inverse CDF: smallest k with F(k) >= u, for any lambda.

    A mean above ``_POISSON_PIECE`` is split into equal pieces, whose independent
    draws are added (a sum of Poisson variables is Poisson).  Each piece walks up to
    its mean + 12 sd + 40, beyond which the tail is below the uniforms' 2^-53 steps.
    The work grows with lambda: for totals of many draws use ``exact_poisson``.
    """
    lam = F.lit(float(lam)) if not isinstance(lam, Column) else lam
    pieces = F.greatest(F.ceil(lam / F.lit(_POISSON_PIECE)).cast("int"), F.lit(1))
    mean = lam / pieces
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(40.0)).cast("int")

    def one(u):
        # state: (k_found, cdf, pmf); pmf_k = pmf_{k-1} * mean / k
        init = F.struct(F.lit(-1).alias("k"), F.exp(-mean).alias("cdf"), F.exp(-mean).alias("pmf"))

        def step(acc, k):
            pmf = F.when(k == 0, acc["pmf"]).otherwise(acc["pmf"] * mean / k)
            cdf = F.when(k == 0, acc["cdf"]).otherwise(acc["cdf"] + pmf)
            found = F.when((acc["k"] < 0) & (cdf >= u), k).otherwise(acc["k"])
            return F.struct(found.alias("k"), cdf.alias("cdf"), pmf.alias("pmf"))

        res = F.aggregate(F.sequence(F.lit(0), last), init, step)
        return F.when(res["k"] < 0, last).otherwise(res["k"])

    return F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0),
                       lambda acc, j: acc + one(hash_uniform(*cols, j, seed=seed)))


@F.pandas_udf(T.DoubleType())
def exact_poisson(row_seed: pd.Series, lam: pd.Series) -> pd.Series:
    """One Poisson draw per row of any mean (transformed rejection), from a generator that the
    row's seed starts; the same at every size and partitioning."""
    import numpy as np
    seeds = row_seed.to_numpy(np.int64).view(np.uint64)
    return pd.Series([float(np.random.Generator(np.random.Philox(key=int(s))).poisson(m))
                      for s, m in zip(seeds, lam.to_numpy(float), strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def exact_chi2(row_seed: pd.Series, dof: pd.Series) -> pd.Series:
    """One chi-square draw per row, from a generator that the row's seed starts."""
    import numpy as np
    seeds = row_seed.to_numpy(np.int64).view(np.uint64)
    return pd.Series([float(np.random.Generator(np.random.Philox(key=int(s))).chisquare(k))
                      for s, k in zip(seeds, dof.to_numpy(float), strict=True)], dtype="float64")


# --- counter-based draws from one row seed (vectorised) -------------------
# The splitmix64 increment and multipliers.
_GOLDEN = 0x9E3779B97F4A7C15
_MIX1 = 0xBF58476D1CE4E5B9
_MIX2 = 0x94D049BB133111EB


def row_seed(*cols, seed: int = 0) -> Column:
    """One 64-bit seed per row: ``xxhash64(keys..., seed)`` (JVM, codegen)."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*parts, F.lit(int(seed)))


def counter_uniforms(seeds, draws):
    """U[0,1) for (row seed, draw index) pairs by splitmix64 (numpy, wraps
    in uint64).  ``seeds`` shape (n,) int64, ``draws`` shape (m,) or (n, m)."""
    import numpy as np
    with np.errstate(over="ignore"):
        x = np.asarray(seeds).astype(np.uint64)[:, None]
        d = np.asarray(draws).astype(np.uint64)
        z = x + np.uint64(_GOLDEN) * (d + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX2)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / TWO53


_BLOCK = 16384  # numbers worked on at once: the temporaries stay in a core's cache


def counter_counts(seeds, n_draws: int, p):
    """How many of the :func:`counter_uniforms` of draws 0 to n_draws - 1 are below ``p``, per row
    seed; a null (NaN) p has none.  Works in place on one block of seeds x draws at a time."""
    import numpy as np
    x, p = np.asarray(seeds, dtype=np.int64).view(np.uint64), np.asarray(p, dtype=float)
    # u < p for u = (z >> 11) / 2^53 is z >> 11 < ceil(p * 2^53) =: cut, so z <= cut * 2^11 - 1, without
    # rounding; a cut of 2^53 wraps to the largest z, one of 0 too, whose rows have none
    cut = np.ceil(np.clip(np.where(np.isnan(p), 0.0, p), 0.0, 1.0) * TWO53).astype(np.uint64)
    last = (cut << np.uint64(11)) - np.uint64(1)
    out = np.zeros(len(x), np.int64)
    many = max(1, min(n_draws, _BLOCK))
    size = max(1, _BLOCK // many)
    z, t, below = (np.empty((size, many), kind) for kind in (np.uint64, np.uint64, np.bool_))
    for b in range(0, n_draws, many):
        counter = np.uint64(_GOLDEN) * np.arange(b + 1, min(b + many, n_draws) + 1, dtype=np.uint64)
        for a in range(0, len(x), size):
            at = slice(a, min(a + size, len(x)))
            z_, t_, below_ = (v[:at.stop - a, :len(counter)] for v in (z, t, below))
            np.add(x[at, None], counter, out=z_)
            for shift, mix in ((30, _MIX1), (27, _MIX2), (31, None)):
                np.right_shift(z_, np.uint64(shift), out=t_)
                z_ ^= t_
                if mix is not None:
                    z_ *= np.uint64(mix)
            np.less_equal(z_, last[at, None], out=below_)
            out[at] += below_.sum(axis=1)
    return np.where(cut > 0, out, 0)


def key_uniforms(prefixes, n_draws: int, seed: int = 0):
    """The portable uniforms of draws 0 to n_draws - 1, rows x draws, in blocks: (row numbers,
    draw numbers, uniforms).

    ``prefixes`` are rows' keys as bytes, as :func:`key_prefix` gives them; the uniforms are
    those of ``hash_uniform(*keys, draw, seed=seed, portable=True)``.  Texts of one length have
    their key, draw and padding in the same places, so they are hashed at once.
    """
    import numpy as np
    tails = [f"{d}|{seed}".encode() for d in range(n_draws)]
    for rows, left in _same_length(prefixes):
        size = left.shape[1]
        for draws, tail in _same_length(tails):
            end = size + tail.shape[1]
            width = 64 * ((end + 8) // 64 + 1)
            right = np.zeros((len(draws), width), np.uint8)
            right[:, size:end], right[:, end] = tail, 0x80
            right[:, width - 8:] = np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
            right = right.view("<u4")
            many = min(len(draws), _BLOCK)
            step = max(1, _BLOCK // many)
            for a in range(0, len(rows), step):
                head = np.zeros((len(left[a:a + step]), width), np.uint8)
                head[:, :size] = left[a:a + step]
                head = head.view("<u4")
                for b in range(0, len(draws), many):
                    # a word of the key alone or of the draw alone stays one column or one row
                    words = [head[:, k, None] if 4 * k + 4 <= size else right[None, b:b + many, k] if 4 * k >= size
                             else head[:, k, None] | right[None, b:b + many, k] for k in range(width // 4)]
                    u = _md5_first_word(words).byteswap() / TWO32
                    yield rows[a:a + step], draws[b:b + many], u


def key_prefix(*cols) -> Column:
    """What :func:`hash_uniform` hashes before the draw in its portable form, as bytes."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.concat_ws("|", *parts, F.lit("")).cast("binary")


def _same_length(texts):
    """(positions, bytes as a matrix) for each length of the texts."""
    import numpy as np
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), n)


_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_TURN = [*(7, 12, 17, 22) * 4, *(5, 9, 14, 20) * 4, *(4, 11, 16, 23) * 4, *(6, 10, 15, 21) * 4]
_MD5_ADD = [int(abs(math.sin(i + 1)) * TWO32) for i in range(64)]


def _md5_first_word(words):
    """First 32 bits of the MD5 (little-endian) of padded messages; word k of all messages is
    the uint32 array ``words[k]``, and these broadcast."""
    import numpy as np
    shape = np.broadcast_shapes(*(w.shape for w in words))
    state = [np.full(shape, v, np.uint32) for v in _MD5_START]
    f = np.empty(shape, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (v.copy() for v in state)
        for i in range(64):  # in place: a step makes no new arrays
            if i < 16:
                k = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                k = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                k = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                k = 7 * i % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            a += f
            a += words[at + k] + np.uint32(_MD5_ADD[i])
            np.left_shift(a, np.uint32(_MD5_TURN[i]), out=f)
            a >>= np.uint32(32 - _MD5_TURN[i])
            a |= f
            a += b
            a, b, c, d = d, a, b, c
        for total, v in zip(state, (a, b, c, d), strict=True):
            total += v
    return state[0]


# --- SQL text of the same formulas, for independent engines (oracles) ----

def sql_uniform(*cols: str, seed: int = 0, stream: int | None = None) -> str:
    parts = [f"CAST({c} AS VARCHAR)" for c in cols] + [f"'{seed}'"]
    if stream is not None:
        parts.append(f"'{stream}'")
    key = "concat_ws('|', " + ", ".join(parts) + ")"
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"
