"""FlowSpec: which columns are features, label, id and time; names and alias rule of flow features."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, types as T

BENIGN = "BENIGN"

# Feature names of a raw flow file in file order. A leading space is part of the raw name.
RAW_FEATURES = [
    " Source Port", " Destination Port", " Protocol", " Flow Duration", " Total Fwd Packets",
    " Total Backward Packets", "Total Length of Fwd Packets", " Total Length of Bwd Packets",
    " Fwd Packet Length Max", " Fwd Packet Length Min", " Fwd Packet Length Mean", " Fwd Packet Length Std",
    "Bwd Packet Length Max", " Bwd Packet Length Min", " Bwd Packet Length Mean", " Bwd Packet Length Std",
    "Flow Bytes/s", " Flow Packets/s", " Flow IAT Mean", " Flow IAT Std", " Flow IAT Max", " Flow IAT Min",
    "Fwd IAT Total", " Fwd IAT Mean", " Fwd IAT Std", " Fwd IAT Max", " Fwd IAT Min",
    "Bwd IAT Total", " Bwd IAT Mean", " Bwd IAT Std", " Bwd IAT Max", " Bwd IAT Min",
    "Fwd PSH Flags", " Bwd PSH Flags", " Fwd URG Flags", " Bwd URG Flags",
    " Fwd Header Length", " Bwd Header Length", "Fwd Packets/s", " Bwd Packets/s",
    " Min Packet Length", " Max Packet Length", " Packet Length Mean", " Packet Length Std",
    " Packet Length Variance", "FIN Flag Count", " SYN Flag Count", " RST Flag Count", " PSH Flag Count",
    " ACK Flag Count", " URG Flag Count", " CWE Flag Count", " ECE Flag Count", " Down/Up Ratio",
    " Average Packet Size", " Avg Fwd Segment Size", " Avg Bwd Segment Size", " Fwd Header Length.1",
    "Fwd Avg Bytes/Bulk", " Fwd Avg Packets/Bulk", " Fwd Avg Bulk Rate",
    " Bwd Avg Bytes/Bulk", " Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", " Subflow Fwd Bytes", " Subflow Bwd Packets", " Subflow Bwd Bytes",
    "Init_Win_bytes_forward", " Init_Win_bytes_backward", " act_data_pkt_fwd", " min_seg_size_forward",
    "Active Mean", " Active Std", " Active Max", " Active Min", "Idle Mean", " Idle Std", " Idle Max", " Idle Min",
]

# Columns dropped by cleaning, the wider list used for whole-day training, and alias exceptions.
#: Map of the texts that a scan found in columns of numbers.
RESCUED = "_rescued"
METADATA_COLUMNS = ["Flow ID", "Source IP", "Destination IP", "Timestamp"]
WIDE_METADATA_COLUMNS = METADATA_COLUMNS + ["Source Port", "Destination Port", "Flow Bytes/s", "Flow Packets/s"]
ALIAS_EXCEPTIONS = {
    "Total Backward Packets": "total_bwd_packets",
    "Total Length of Fwd Packets": "total_length_fwd_packets",
    "Total Length of Bwd Packets": "total_length_bwd_packets",
}
# Columns that requests lack; request fields without a restriction.
NOT_IN_REQUEST = ["Source Port", "Destination Port", "Protocol", "Fwd Header Length.1", "act_data_pkt_fwd",
                  "min_seg_size_forward"]
UNRESTRICTED_REQUEST_FIELDS = [
    "flow_duration", "total_length_fwd_packets", "total_length_bwd_packets", "flow_bytes_per_sec",
    "flow_packets_per_sec", "flow_iat_mean", "flow_iat_std", "init_win_bytes_forward", "init_win_bytes_backward",
]


def safe_name(name: str) -> str:
    """A trimmed name without dots, which Spark reads as access to a struct field."""
    return name.strip().replace(".", "_")


def snake_name(name: str) -> str:
    """Raw or trimmed file name -> snake_case alias (``Flow Bytes/s`` -> ``flow_bytes_per_sec``)."""
    name = name.strip()
    if name in ALIAS_EXCEPTIONS:
        return ALIAS_EXCEPTIONS[name]
    return name.lower().replace("/s", "_per_sec").replace("/", "_").replace(" ", "_").replace(".", "_")


def alias_table() -> dict[str, str]:
    """snake_case alias -> file name as the reader gives it."""
    return {snake_name(raw): safe_name(raw) for raw in RAW_FEATURES}


def to_snake(df: DataFrame) -> DataFrame:
    """Rename every known raw or trimmed feature to its snake_case alias."""
    known = {safe_name(raw) for raw in RAW_FEATURES}
    return df.toDF(*[snake_name(c) if safe_name(c) in known else c for c in df.columns])


def request_fields() -> list[str]:
    """The snake_case fields of one scoring request."""
    return [snake_name(raw) for raw in RAW_FEATURES if raw.strip() not in NOT_IN_REQUEST]


@dataclass(frozen=True)
class FlowSpec:
    """Names the roles of columns; the feature list is always explicit, never a constant width."""

    features: tuple[str, ...]
    label: str = "label"
    keys: tuple[str, ...] = ()
    time: str | None = None
    benign: str = BENIGN
    original: str = field(default="label_original")

    def with_features(self, features) -> "FlowSpec":
        return replace(self, features=tuple(features))


def numeric_columns(df: DataFrame) -> list[str]:
    """Number-typed columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def split_columns(df: DataFrame, label: str = "Label", original: str = "Label_Original") -> list[str]:
    """Every column but the label and its original."""
    return [c for c in df.columns if c not in (label, original)]
