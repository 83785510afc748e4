import datetime
import struct

from packetlens.functions.net import has_flag, ip_to_long, ip_to_string, is_syn
from packetlens.schemas import FRAMES
from packetlens.sources.frames import decode_descriptors, decode_frames, read_frames
from pyspark.sql import functions as F

TS = datetime.datetime(2024, 1, 1, 0, 0, 1, 250000)


def ip_number(text):
    return struct.unpack(">I", bytes(int(p) for p in text.split(".")))[0]


def frame(proto=6, src="192.168.1.10", dst="10.0.0.1", sport=54321, dport=80, flags=2, first=0x45, ethertype=0x0800, length=54):
    ihl = (first & 15) * 4
    head = bytes(12) + struct.pack(">H", ethertype)
    ip = bytes([first]) + bytes(8) + bytes([proto]) + bytes(2) + struct.pack(">II", ip_number(src), ip_number(dst))
    ip += bytes(max(0, ihl - len(ip)))
    transport = struct.pack(">HH", sport, dport) + bytes(8) + bytes([0x50, flags]) + bytes(6)
    return (head + ip + transport)[:length] + bytes(max(0, length - len(head + ip + transport)))


def decoded(spark, *frames):
    rows = [(f, len(f), TS) if isinstance(f, bytes) else (f[0], f[1], TS) for f in frames]
    return decode_frames(spark.createDataFrame(rows, FRAMES)).collect()


def test_tcp_syn(spark):
    (p,) = decoded(spark, frame())
    assert (p.protocol, p.src_port, p.dst_port, p.tcp_flags, p.packet_size) == (6, 54321, 80, 2, 40)
    assert (p.src_ip, p.dst_ip) == (ip_number("192.168.1.10"), ip_number("10.0.0.1"))
    assert p.ts_us == 1704067201250000


def test_syn_ack_predicates(spark):
    rows = spark.createDataFrame([(6, 2), (6, 18), (6, 16), (17, 2), (6, 3)], "protocol int, tcp_flags int")
    got = rows.select(is_syn(), has_flag("ACK"), has_flag("FIN")).collect()
    assert [tuple(r) for r in got] == [
        (True, False, False), (False, True, False), (False, True, False), (False, False, False), (True, False, True),
    ]


def test_udp_and_icmp(spark):
    udp, icmp = decoded(
        spark, frame(17, "172.16.0.5", "8.8.8.8", 1234, 53, length=42), frame(1, length=34)
    )
    assert (udp.protocol, udp.src_port, udp.dst_port, udp.tcp_flags) == (17, 1234, 53, 0)
    assert (icmp.protocol, icmp.src_port, icmp.dst_port, icmp.packet_size) == (1, 0, 0, 20)


def test_frames_that_are_dropped(spark):
    bad = [
        b"\x00\x01\x02",
        bytes(12) + b"\x08\x06",
        frame(ethertype=0x86DD),
        frame(proto=47),
        frame(first=0x65),
        (frame(), 14),
        (frame(), 33),
        (frame(), 47),  # TCP with 13 bytes
        (frame(17, length=42), 41),  # UDP with 7 bytes
        (frame(first=0x4F), 60),  # header longer than the frame
    ]
    assert decoded(spark, *bad) == []


def test_shortest_readable_transports(spark):
    tcp, udp = decoded(spark, (frame(length=48), 48), (frame(17, length=42), 42))
    assert (tcp.tcp_flags, udp.dst_port) == (2, 80)


def test_long_ip_header(spark):
    (p,) = decoded(spark, frame(first=0x46, length=58))
    assert (p.src_port, p.dst_port, p.tcp_flags) == (54321, 80, 2)


def test_size_wraps_at_16_bits(spark):
    (p,) = decoded(spark, (frame(), 65536 + 14 + 60))
    assert p.packet_size == 60


def test_descriptors(spark):
    record = struct.pack("<IIHHBBHQ", 0xC0A8010A, 0x0A000001, 54321, 80, 6, 2, 1500, 1704067200000001999)
    rows = spark.createDataFrame([(bytearray(record),), (bytearray(record[:23]),)], "record binary")
    (p,) = decode_descriptors(rows).collect()
    assert (p.src_ip, p.dst_ip, p.src_port, p.dst_port) == (0xC0A8010A, 0x0A000001, 54321, 80)
    assert (p.protocol, p.tcp_flags, p.packet_size, p.ts_us) == (6, 2, 1500, 1704067200000001)


def test_ip_text_both_ways(spark):
    texts = ["192.168.1.1", "10.0.0.1", "8.8.8.8", "255.255.255.255"]
    rows = spark.createDataFrame([(ip_number(t), t) for t in texts], "n long, t string")
    assert rows.filter((ip_to_string("n") == F.col("t")) & (ip_to_long("t") == F.col("n"))).count() == 4
    assert spark.createDataFrame([("1.2.3",)], "t string").select(ip_to_long("t")).first()[0] is None


def test_frames_from_a_table_and_a_stream(spark, tmp_path):
    path = str(tmp_path / "frames")
    spark.createDataFrame([(frame(), 54, TS), (b"x", 1, TS)], FRAMES).write.parquet(path)
    assert decode_frames(read_frames(spark, path)).count() == 1
    query = (
        decode_frames(read_frames(spark, path, streaming=True)).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).first().dst_port == 80
