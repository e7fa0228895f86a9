"""Schemas of the trace tables."""

from __future__ import annotations

from pyspark.sql import types as T

I, L, S, D, B = T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
PAPI = 6  # hardware counters kept


def _of(fields: str, **kinds: T.DataType) -> T.StructType:
    """``"a:i b:l?"``: names with a kind (i, l, s, d, b); ? marks nullable."""
    named = {"i": I, "l": L, "s": S, "d": D, "b": B}
    parts = [f.partition(":") for f in fields.split()]
    return T.StructType([T.StructField(n, named[k.rstrip("?")], k.endswith("?")) for n, _, k in parts])


def _counters(name: str) -> str:
    return " ".join(f"{name}_{i}:l?" for i in range(PAPI))


SCHEMAS: dict[str, T.StructType] = {
    "processing_element": _of("pe_id:i total_pes:i begin_time_us:l? end_time_us:l? global_start_us:l? computation_duration_us:l? aligned_begin_us:l?"),
    "chare_collection": _of("collection_id:i name:s ndims:i"),
    "entry_method": _of("ep_id:i name:s collection_id:i msg_idx:i"),
    "chare_instance": _of("instance_id:l collection_id:i " + " ".join(f"index_{i}:i" for i in range(6))),
    "execution": _of(
        "pe_id:i event:i instance_id:l? ep_id:i src_pe:i msg_idx:i msg_len:i start_time_us:l recv_time_us:l? start_cpu_us:l end_time_us:l? end_cpu_us:l? "
        + f"{_counters('papi_begin')} {_counters('papi_end')} wall_duration_us:l? cpu_duration_us:l? queue_wait_us:l? {_counters('papi_delta')}"
    ),
    "message": _of(
        "message_id:l src_pe:i event:i ep_id:i msg_idx:i msg_len:i send_time_us:l enqueue_time_us:l? is_broadcast:b broadcast_fanout:i? dst_pe:i? recv_time_us:l? "
        "exec_start_time_us:l? send_to_enqueue_us:l? enqueue_to_exec_us:l? end_to_end_us:l?"
    ),
    "idle_interval": _of("pe_id:i start_time_us:l end_time_us:l? duration_us:l?"),
    "migration_episode": _of("migration_id:l instance_id:l collection_id:i src_pe:i dst_pe:i last_exec_end_src_us:l first_exec_start_dst_us:l gap_us:l migration_seq:i"),
    "user_event": _of("pe_id:i record_type:i user_event_id:i? name:s? event:i? nested_id:i? start_time_us:l end_time_us:l? duration_us:l? user_supplied_int:i? note:s?"),
    "simulation_step": _of("step_id:i pe_id:i start_time_us:l end_time_us:l? duration_us:l? global_start_time_us:l global_end_time_us:l? pe_count:i"),
    "message_type": _of("msg_idx:i size_bytes:l"),
    "user_stat": _of("pe_id:i stat_id:i name:s? time_us:l stat_value:d user_time_s:d?"),
    "memory_sample": _of("pe_id:i time_us:l bytes:l"),
}
REQUIRED = ["processing_element", "chare_collection", "entry_method", "chare_instance", "execution", "message", "idle_interval", "migration_episode"]
OPTIONAL = [name for name in SCHEMAS if name not in REQUIRED]
