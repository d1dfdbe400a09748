"""Dataset descriptors: schema, column roles and per-dataset settings.

A :class:`FlowSpec` carries everything the operators need to know about one
family of flow logs, so that no operator hard-codes a column name.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# Seed, tree shape and clustering settings of the published method.
SEED = 10
TREE_MAX_DEPTH = 25
TREE_MAX_BINS = 4096
TREE_MIN_INSTANCES = 1
TREE_IMPURITY = "entropy"
OPTICS_MIN_SAMPLES = 2
OPTICS_XI = 0.05
PRUNE_THRESHOLD = 0.99
REPORT_THRESHOLD = 0.95
TRAIN_FRACTION = 0.7
PCA_SAMPLE_FRACTION = 0.2
CLUSTER_SAMPLE_FRACTION = 0.05

# Field names and types of the three public datasets, in file order.
IOT23_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("uid", T.StringType()),
        T.StructField("id_orig_h", T.StringType()),
        T.StructField("id_orig_p", T.IntegerType()),
        T.StructField("id_resp_h", T.StringType()),
        T.StructField("id_resp_p", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("orig_bytes", T.LongType()),
        T.StructField("resp_bytes", T.LongType()),
        T.StructField("conn_state", T.StringType()),
        T.StructField("local_orig", T.IntegerType()),
        T.StructField("local_resp", T.IntegerType()),
        T.StructField("missed_bytes", T.IntegerType()),
        T.StructField("history", T.StringType()),
        T.StructField("orig_pkts", T.IntegerType()),
        T.StructField("orig_ip_bytes", T.LongType()),
        T.StructField("resp_pkts", T.IntegerType()),
        T.StructField("resp_ip_bytes", T.LongType()),
        T.StructField("tunnel_parents", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("detailed_label", T.StringType()),
    ]
)

# stcpb and dtcpb are unsigned 32-bit sequence numbers, hence LongType.
UNSW_SCHEMA = T.StructType(
    [
        T.StructField("srcip", T.StringType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dstip", T.StringType()),
        T.StructField("dsport", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("dur", T.DoubleType()),
        T.StructField("sbytes", T.IntegerType()),
        T.StructField("dbytes", T.IntegerType()),
        T.StructField("sttl", T.IntegerType()),
        T.StructField("dttl", T.IntegerType()),
        T.StructField("sloss", T.IntegerType()),
        T.StructField("dloss", T.IntegerType()),
        T.StructField("service", T.StringType()),
        T.StructField("Sload", T.DoubleType()),
        T.StructField("Dload", T.DoubleType()),
        T.StructField("Spkts", T.IntegerType()),
        T.StructField("Dpkts", T.IntegerType()),
        T.StructField("swin", T.IntegerType()),
        T.StructField("dwin", T.IntegerType()),
        T.StructField("stcpb", T.LongType()),
        T.StructField("dtcpb", T.LongType()),
        T.StructField("smeansz", T.IntegerType()),
        T.StructField("dmeansz", T.IntegerType()),
        T.StructField("trans_depth", T.IntegerType()),
        T.StructField("res_bdy_len", T.IntegerType()),
        T.StructField("Sjit", T.DoubleType()),
        T.StructField("Djit", T.DoubleType()),
        T.StructField("Stime", T.LongType()),
        T.StructField("Ltime", T.LongType()),
        T.StructField("Sintpkt", T.DoubleType()),
        T.StructField("Dintpkt", T.DoubleType()),
        T.StructField("tcprtt", T.DoubleType()),
        T.StructField("synack", T.DoubleType()),
        T.StructField("ackdat", T.DoubleType()),
        T.StructField("is_sm_ips_ports", T.IntegerType()),
        T.StructField("ct_state_ttl", T.IntegerType()),
        T.StructField("ct_flw_http_mthd", T.IntegerType()),
        T.StructField("is_ftp_login", T.IntegerType()),
        T.StructField("ct_ftp_cmd", T.IntegerType()),
        T.StructField("ct_srv_src", T.IntegerType()),
        T.StructField("ct_srv_dst", T.IntegerType()),
        T.StructField("ct_dst_ltm", T.IntegerType()),
        T.StructField("ct_src_ltm", T.IntegerType()),
        T.StructField("ct_src_dport_ltm", T.IntegerType()),
        T.StructField("ct_dst_sport_ltm", T.IntegerType()),
        T.StructField("ct_dst_src_ltm", T.IntegerType()),
        T.StructField("attack_cat", T.StringType()),
        T.StructField("Label", T.IntegerType()),
    ]
)

IOTID20_SCHEMA = T.StructType(
    [
        T.StructField("Flow_ID", T.StringType()),
        T.StructField("Src_IP", T.StringType()),
        T.StructField("Src_Port", T.IntegerType()),
        T.StructField("Dst_IP", T.StringType()),
        T.StructField("Dst_Port", T.IntegerType()),
        T.StructField("Protocol", T.IntegerType()),
        T.StructField("Timestamp", T.StringType()),
        T.StructField("Flow_Duration", T.IntegerType()),
        T.StructField("Tot_Fwd_Pkts", T.IntegerType()),
        T.StructField("Tot_Bwd_Pkts", T.IntegerType()),
        T.StructField("TotLen_Fwd_Pkts", T.DoubleType()),
        T.StructField("TotLen_Bwd_Pkts", T.DoubleType()),
        T.StructField("Fwd_Pkt_Len_Max", T.DoubleType()),
        T.StructField("Fwd_Pkt_Len_Min", T.DoubleType()),
        T.StructField("Fwd_Pkt_Len_Mean", T.DoubleType()),
        T.StructField("Fwd_Pkt_Len_Std", T.DoubleType()),
        T.StructField("Bwd_Pkt_Len_Max", T.DoubleType()),
        T.StructField("Bwd_Pkt_Len_Min", T.DoubleType()),
        T.StructField("Bwd_Pkt_Len_Mean", T.DoubleType()),
        T.StructField("Bwd_Pkt_Len_Std", T.DoubleType()),
        T.StructField("Flow_Byts/s", T.DoubleType()),
        T.StructField("Flow_Pkts/s", T.DoubleType()),
        T.StructField("Flow_IAT_Mean", T.DoubleType()),
        T.StructField("Flow_IAT_Std", T.DoubleType()),
        T.StructField("Flow_IAT_Max", T.DoubleType()),
        T.StructField("Flow_IAT_Min", T.DoubleType()),
        T.StructField("Fwd_IAT_Tot", T.DoubleType()),
        T.StructField("Fwd_IAT_Mean", T.DoubleType()),
        T.StructField("Fwd_IAT_Std", T.DoubleType()),
        T.StructField("Fwd_IAT_Max", T.DoubleType()),
        T.StructField("Fwd_IAT_Min", T.DoubleType()),
        T.StructField("Bwd_IAT_Tot", T.DoubleType()),
        T.StructField("Bwd_IAT_Mean", T.DoubleType()),
        T.StructField("Bwd_IAT_Std", T.DoubleType()),
        T.StructField("Bwd_IAT_Max", T.DoubleType()),
        T.StructField("Bwd_IAT_Min", T.DoubleType()),
        T.StructField("Fwd_PSH_Flags", T.IntegerType()),
        T.StructField("Bwd_PSH_Flags", T.IntegerType()),
        T.StructField("Fwd_URG_Flags", T.IntegerType()),
        T.StructField("Bwd_URG_Flags", T.IntegerType()),
        T.StructField("Fwd_Header_Len", T.IntegerType()),
        T.StructField("Bwd_Header_Len", T.IntegerType()),
        T.StructField("Fwd_Pkts/s", T.DoubleType()),
        T.StructField("Bwd_Pkts/s", T.DoubleType()),
        T.StructField("Pkt_Len_Min", T.DoubleType()),
        T.StructField("Pkt_Len_Max", T.DoubleType()),
        T.StructField("Pkt_Len_Mean", T.DoubleType()),
        T.StructField("Pkt_Len_Std", T.DoubleType()),
        T.StructField("Pkt_Len_Var", T.DoubleType()),
        T.StructField("FIN_Flag_Cnt", T.IntegerType()),
        T.StructField("SYN_Flag_Cnt", T.IntegerType()),
        T.StructField("RST_Flag_Cnt", T.IntegerType()),
        T.StructField("PSH_Flag_Cnt", T.IntegerType()),
        T.StructField("ACK_Flag_Cnt", T.IntegerType()),
        T.StructField("URG_Flag_Cnt", T.IntegerType()),
        T.StructField("CWE_Flag_Count", T.IntegerType()),
        T.StructField("ECE_Flag_Cnt", T.IntegerType()),
        T.StructField("Down/Up_Ratio", T.DoubleType()),
        T.StructField("Pkt_Size_Avg", T.DoubleType()),
        T.StructField("Fwd_Seg_Size_Avg", T.DoubleType()),
        T.StructField("Bwd_Seg_Size_Avg", T.DoubleType()),
        T.StructField("Fwd_Byts/b_Avg", T.IntegerType()),
        T.StructField("Fwd_Pkts/b_Avg", T.IntegerType()),
        T.StructField("Fwd_Blk_Rate_Avg", T.IntegerType()),
        T.StructField("Bwd_Byts/b_Avg", T.IntegerType()),
        T.StructField("Bwd_Pkts/b_Avg", T.IntegerType()),
        T.StructField("Bwd_Blk_Rate_Avg", T.IntegerType()),
        T.StructField("Subflow_Fwd_Pkts", T.IntegerType()),
        T.StructField("Subflow_Fwd_Byts", T.IntegerType()),
        T.StructField("Subflow_Bwd_Pkts", T.IntegerType()),
        T.StructField("Subflow_Bwd_Byts", T.IntegerType()),
        T.StructField("Init_Fwd_Win_Byts", T.IntegerType()),
        T.StructField("Init_Bwd_Win_Byts", T.IntegerType()),
        T.StructField("Fwd_Act_Data_Pkts", T.IntegerType()),
        T.StructField("Fwd_Seg_Size_Min", T.IntegerType()),
        T.StructField("Active_Mean", T.DoubleType()),
        T.StructField("Active_Std", T.DoubleType()),
        T.StructField("Active_Max", T.DoubleType()),
        T.StructField("Active_Min", T.DoubleType()),
        T.StructField("Idle_Mean", T.DoubleType()),
        T.StructField("Idle_Std", T.DoubleType()),
        T.StructField("Idle_Max", T.DoubleType()),
        T.StructField("Idle_Min", T.DoubleType()),
        T.StructField("Label", T.StringType()),
        T.StructField("Cat", T.StringType()),
        T.StructField("Sub_Cat", T.StringType()),
    ]
)


@dataclass(frozen=True)
class FlowSpec:
    """One dataset: where it lives, how it is read, and what each column is for."""

    name: str
    path: str
    kind: str  # "csv" or "zeek"
    file_glob: str
    schema: T.StructType
    uid: str
    noisy: tuple[str, ...]  # kept in the table, never a feature
    labels: tuple[str, ...]  # [0] binary label, [1] attack type, rest only protected
    five_tuple: dict[str, str]  # SIP, SPort, DIP, DPort, Proto -> column
    header: bool = False
    generated_uid: bool = False
    positive_label: str | None = None  # None: the label is an int already
    label_default: str | None = None  # value of a missing attack type
    pca_variance: float | None = None  # choose k by explained share ...
    pca_k: int | None = None  # ... or take it as given
    sample_size: int | None = None  # rows to cluster; None: all
    sample_method: str = "random"  # or "balanced"
    response_bytes: str | None = None  # answered-bytes column of the source profile
    exclude: tuple[str, ...] = ()  # further columns to keep out of the features

    @property
    def label(self) -> str:
        return self.labels[0]

    @property
    def attack(self) -> str | None:
        return self.labels[1] if len(self.labels) > 1 else None

    @property
    def protected(self) -> set[str]:
        """Columns that never become features; the row id is always one of them."""
        return {self.uid, *self.noisy, *self.labels, *self.exclude}

    def at(self, path: str) -> FlowSpec:
        """The same dataset under another root folder."""
        return replace(self, path=path)

    def stage(self, name: str) -> str:
        return f"{self.path}/{name}"


# Column roles and settings of the three public datasets.
SPECS: dict[str, FlowSpec] = {
    "iot23": FlowSpec(
        name="iot23",
        path="Dataset/iot23_small",
        kind="zeek",
        file_glob="*conn.log.labeled",
        schema=IOT23_SCHEMA,
        uid="uid",
        noisy=("uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "local_orig", "local_resp", "ts"),
        labels=("label", "detailed_label"),
        five_tuple={
            "SIP": "id_orig_h",
            "SPort": "id_orig_p",
            "DIP": "id_resp_h",
            "DPort": "id_resp_p",
            "Proto": "proto",
        },
        positive_label="Malicious",
        label_default="Benign",
        pca_variance=0.95,
        sample_method="balanced",
        response_bytes="resp_bytes",
    ),
    "iotid20": FlowSpec(
        name="iotid20",
        path="Dataset/iotId20",
        kind="csv",
        file_glob="IoT Network Intrusion Dataset.csv",
        header=True,
        schema=IOTID20_SCHEMA,
        uid="uid",
        generated_uid=True,
        noisy=("Flow_ID", "Src_IP", "Src_Port", "Dst_IP", "Dst_Port"),
        labels=("Label", "Cat", "Sub_Cat"),
        five_tuple={
            "SIP": "Src_IP",
            "SPort": "Src_Port",
            "DIP": "Dst_IP",
            "DPort": "Dst_Port",
            "Proto": "Protocol",
        },
        positive_label="Anomaly",
        pca_k=20,
        response_bytes="TotLen_Bwd_Pkts",
    ),
    "unsw": FlowSpec(
        name="unsw",
        path="Dataset/UNSW_NB15",
        kind="csv",
        file_glob="UNSW-NB15_[1-4].csv",
        schema=UNSW_SCHEMA,
        uid="uid",
        generated_uid=True,
        noisy=("uid", "srcip", "sport", "dstip", "dsport"),
        labels=("Label", "attack_cat", "is_ftp_login"),
        five_tuple={
            "SIP": "srcip",
            "SPort": "sport",
            "DIP": "dstip",
            "DPort": "dsport",
            "Proto": "proto",
        },
        pca_k=30,
        response_bytes="dbytes",
    ),
}
