"""Two labelled example flows (S8): a benign request and a slow denial-of-service flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.spec import RAW_FEATURES, safe_name

# The features of two flows by name.
BENIGN_FLOW = {
    " Source Port": 49459.0,
    " Destination Port": 80.0,
    " Protocol": 6.0,
    " Flow Duration": 38308.0,
    " Total Fwd Packets": 1.0,
    " Total Backward Packets": 1.0,
    "Total Length of Fwd Packets": 6.0,
    " Total Length of Bwd Packets": 6.0,
    " Fwd Packet Length Max": 6.0,
    " Fwd Packet Length Min": 6.0,
    " Fwd Packet Length Mean": 6.0,
    " Fwd Packet Length Std": 0.0,
    "Bwd Packet Length Max": 6.0,
    " Bwd Packet Length Min": 6.0,
    " Bwd Packet Length Mean": 6.0,
    " Bwd Packet Length Std": 0.0,
    "Flow Bytes/s": 313.250496,
    " Flow Packets/s": 52.208416,
    " Flow IAT Mean": 38308.0,
    " Flow IAT Std": 0.0,
    " Flow IAT Max": 38308.0,
    " Flow IAT Min": 38308.0,
    "Fwd IAT Total": 0.0,
    " Fwd IAT Mean": 0.0,
    " Fwd IAT Std": 0.0,
    " Fwd IAT Max": 0.0,
    " Fwd IAT Min": 0.0,
    "Bwd IAT Total": 0.0,
    " Bwd IAT Mean": 0.0,
    " Bwd IAT Std": 0.0,
    " Bwd IAT Max": 0.0,
    " Bwd IAT Min": 0.0,
    "Fwd PSH Flags": 0.0,
    " Bwd PSH Flags": 0.0,
    " Fwd URG Flags": 0.0,
    " Bwd URG Flags": 0.0,
    " Fwd Header Length": 20.0,
    " Bwd Header Length": 20.0,
    "Fwd Packets/s": 26.104208,
    " Bwd Packets/s": 26.104208,
    " Min Packet Length": 6.0,
    " Max Packet Length": 6.0,
    " Packet Length Mean": 6.0,
    " Packet Length Std": 0.0,
    " Packet Length Variance": 0.0,
    "FIN Flag Count": 0.0,
    " SYN Flag Count": 0.0,
    " RST Flag Count": 0.0,
    " PSH Flag Count": 0.0,
    " ACK Flag Count": 1.0,
    " URG Flag Count": 1.0,
    " CWE Flag Count": 0.0,
    " ECE Flag Count": 0.0,
    " Down/Up Ratio": 1.0,
    " Average Packet Size": 9.0,
    " Avg Fwd Segment Size": 6.0,
    " Avg Bwd Segment Size": 6.0,
    " Fwd Header Length.1": 20.0,
    "Fwd Avg Bytes/Bulk": 0.0,
    " Fwd Avg Packets/Bulk": 0.0,
    " Fwd Avg Bulk Rate": 0.0,
    " Bwd Avg Bytes/Bulk": 0.0,
    " Bwd Avg Packets/Bulk": 0.0,
    "Bwd Avg Bulk Rate": 0.0,
    "Subflow Fwd Packets": 1.0,
    " Subflow Fwd Bytes": 6.0,
    " Subflow Bwd Packets": 1.0,
    " Subflow Bwd Bytes": 6.0,
    "Init_Win_bytes_forward": 255.0,
    " Init_Win_bytes_backward": 946.0,
    " act_data_pkt_fwd": 0.0,
    " min_seg_size_forward": 20.0,
    "Active Mean": 0.0,
    " Active Std": 0.0,
    " Active Max": 0.0,
    " Active Min": 0.0,
    "Idle Mean": 0.0,
    " Idle Std": 0.0,
    " Idle Max": 0.0,
    " Idle Min": 0.0,
}
SLOW_DOS_FLOW = {
    " Source Port": 49631.0,
    " Destination Port": 80.0,
    " Protocol": 6.0,
    " Flow Duration": 5169956.0,
    " Total Fwd Packets": 8.0,
    " Total Backward Packets": 6.0,
    "Total Length of Fwd Packets": 1101.0,
    " Total Length of Bwd Packets": 4222.0,
    " Fwd Packet Length Max": 410.0,
    " Fwd Packet Length Min": 0.0,
    " Fwd Packet Length Mean": 137.625,
    " Fwd Packet Length Std": 185.75862790000002,
    "Bwd Packet Length Max": 3525.0,
    " Bwd Packet Length Min": 0.0,
    " Bwd Packet Length Mean": 703.6666667000001,
    " Bwd Packet Length Std": 1395.868284,
    "Flow Bytes/s": 1029.6025730000001,
    " Flow Packets/s": 2.707953414,
    " Flow IAT Mean": 397688.9231,
    " Flow IAT Std": 1368409.299,
    " Flow IAT Max": 4951173.0,
    " Flow IAT Min": 112.0,
    "Fwd IAT Total": 218783.0,
    " Fwd IAT Mean": 31254.714289999996,
    " Fwd IAT Std": 30686.293960000003,
    " Fwd IAT Max": 78311.0,
    " Fwd IAT Min": 219.0,
    "Bwd IAT Total": 5169833.0,
    " Bwd IAT Mean": 1033966.6,
    " Bwd IAT Std": 2218975.06,
    " Bwd IAT Max": 5002421.0,
    " Bwd IAT Min": 840.0,
    "Fwd PSH Flags": 0.0,
    " Bwd PSH Flags": 0.0,
    " Fwd URG Flags": 0.0,
    " Bwd URG Flags": 0.0,
    " Fwd Header Length": 172.0,
    " Bwd Header Length": 132.0,
    "Fwd Packets/s": 1.5474019509999999,
    " Bwd Packets/s": 1.160551463,
    " Min Packet Length": 0.0,
    " Max Packet Length": 3525.0,
    " Packet Length Mean": 354.8666667,
    " Packet Length Std": 895.1151456,
    " Packet Length Variance": 801231.1238,
    "FIN Flag Count": 0.0,
    " SYN Flag Count": 0.0,
    " RST Flag Count": 0.0,
    " PSH Flag Count": 1.0,
    " ACK Flag Count": 0.0,
    " URG Flag Count": 0.0,
    " CWE Flag Count": 0.0,
    " ECE Flag Count": 0.0,
    " Down/Up Ratio": 0.0,
    " Average Packet Size": 380.2142857,
    " Avg Fwd Segment Size": 137.625,
    " Avg Bwd Segment Size": 703.6666667000001,
    " Fwd Header Length.1": 172.0,
    "Fwd Avg Bytes/Bulk": 0.0,
    " Fwd Avg Packets/Bulk": 0.0,
    " Fwd Avg Bulk Rate": 0.0,
    " Bwd Avg Bytes/Bulk": 0.0,
    " Bwd Avg Packets/Bulk": 0.0,
    "Bwd Avg Bulk Rate": 0.0,
    "Subflow Fwd Packets": 8.0,
    " Subflow Fwd Bytes": 1101.0,
    " Subflow Bwd Packets": 6.0,
    " Subflow Bwd Bytes": 4222.0,
    "Init_Win_bytes_forward": 8192.0,
    " Init_Win_bytes_backward": 254.0,
    " act_data_pkt_fwd": 7.0,
    " min_seg_size_forward": 20.0,
    "Active Mean": 0.0,
    " Active Std": 0.0,
    " Active Max": 0.0,
    " Active Min": 0.0,
    "Idle Mean": 0.0,
    " Idle Std": 0.0,
    " Idle Max": 0.0,
    " Idle Min": 0.0,
}


def sample_flows(spark: SparkSession) -> DataFrame:
    """Two rows with trimmed feature names and ``Label``."""
    names = [safe_name(n) for n in RAW_FEATURES] + ["Label"]
    schema = ", ".join(f"`{n}` {'string' if n == 'Label' else 'double'}" for n in names)
    rows = [(*(flow[n] for n in RAW_FEATURES), label)
            for flow, label in ((BENIGN_FLOW, "BENIGN"), (SLOW_DOS_FLOW, "DoS slowloris"))]
    return spark.createDataFrame(rows, schema)
