import random

from packetlens.schemas import FLOW_KEY

START = 1_704_067_200_000_000
COLUMNS = "src_ip long, dst_ip long, src_port int, dst_port int, protocol int, packet_size int, tcp_flags int, ts_us long"


def packet(src=1, ts=0, dst=9, sport=1000, dport=80, proto=6, size=100, flags=16):
    """A packet `ts` microseconds after the start of the test clock."""
    return (src, dst, sport, dport, proto, size, flags, START + ts)


def packets(spark, rows, partitions=3):
    return spark.createDataFrame(rows, COLUMNS).repartition(partitions)


def random_packets(n, seed=7, span=70_000_000, sources=3):
    """Packets of which the first source sends a good third; times are coarse, so many are equal."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        src = 1 if rng.random() < 0.35 else rng.randrange(2, 2 + sources)
        out.append(packet(
            src, rng.randrange(span // 1000) * 1000, rng.randrange(2), 1000 + rng.randrange(2), 80 + rng.randrange(30),
            rng.choice([6, 6, 17]), rng.randrange(40, 1500), rng.choice([2, 16, 18]),
        ))
    return out


def as_dicts(rows):
    return [dict(zip([c.split()[0] for c in COLUMNS.split(", ")], r)) for r in rows]


def window_stats(rows, window_us=3_000_000):
    """The sliding statistics by brute force: one dict per packet."""
    rows = as_dicts(rows)
    out = []
    for p in rows:
        near = [q for q in rows if q["src_ip"] == p["src_ip"] and p["ts_us"] - window_us <= q["ts_us"] <= p["ts_us"]]
        flow = [q for q in near if all(q[k] == p[k] for k in FLOW_KEY)]
        out.append({
            **p,
            "src_total_packets": len(near),
            "syn_count": sum(q["protocol"] == 6 and q["tcp_flags"] & 18 == 2 for q in near),
            "src_unique_dst_ports": len({q["dst_port"] for q in near}),
            "packet_count": len(flow),
            "byte_count": sum(q["packet_size"] for q in flow),
        })
    return out


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
