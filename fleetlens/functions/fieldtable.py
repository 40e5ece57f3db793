"""The classified fields of the metric types (fixed values, no logic)."""

# Numeric fields of the five metric types and how each is
# sampled, below payload.elasticsearch.<type>.
NODE_RATE = """
    indices.indexing.index_total
    indices.indexing.index_time_in_millis
    indices.indexing.delete_total
    indices.indexing.delete_time_in_millis
    indices.indexing.noop_update_total
    indices.indexing.throttle_time_in_millis
    indices.search.query_total
    indices.search.query_time_in_millis
    indices.search.fetch_total
    indices.search.fetch_time_in_millis
    indices.search.scroll_total
    indices.search.scroll_time_in_millis
    indices.search.suggest_total
    indices.search.suggest_time_in_millis
    indices.merges.total
    indices.merges.total_time_in_millis
    indices.merges.total_docs
    indices.merges.total_size_in_bytes
    indices.merges.total_stopped_time_in_millis
    indices.merges.total_throttled_time_in_millis
    indices.refresh.total
    indices.refresh.total_time_in_millis
    indices.flush.total
    indices.flush.total_time_in_millis
    indices.get.total
    indices.get.time_in_millis
    indices.get.exists_total
    indices.get.exists_time_in_millis
    indices.get.missing_total
    indices.get.missing_time_in_millis
    indices.request_cache.hit_count
    indices.request_cache.miss_count
    indices.query_cache.hit_count
    indices.query_cache.miss_count
    indices.fielddata.evictions
    indices.query_cache.evictions
    indices.warmer.total
    indices.warmer.total_time_in_millis
    indices.recovery.throttle_time_in_millis
    indices.translog.operations
    indices.translog.size_in_bytes
    indices.translog.uncommitted_operations
    indices.translog.uncommitted_size_in_bytes
    transport.rx_count
    transport.rx_size_in_bytes
    transport.tx_count
    transport.tx_size_in_bytes
    http.total_opened
    fs.io_stats.total.read_operations
    fs.io_stats.total.read_kilobytes
    fs.io_stats.total.write_operations
    fs.io_stats.total.write_kilobytes
    process.cpu.total_in_millis
""".split()

NODE_LATENCY = {
    "indices.search.query_latency": ("indices.search.query_time_in_millis", "indices.search.query_total"),
    "indices.indexing.index_latency": ("indices.indexing.index_time_in_millis", "indices.indexing.index_total"),
    "indices.search.fetch_latency_ms": ("indices.search.fetch_time_in_millis", "indices.search.fetch_total"),
    "indices.indexing.delete_latency_ms": ("indices.indexing.delete_time_in_millis", "indices.indexing.delete_total"),
    "indices.get.latency_ms": ("indices.get.time_in_millis", "indices.get.total"),
}

NODE_MAX = """
    jvm.mem.heap_used_in_bytes
    jvm.mem.heap_used_percent
    jvm.mem.heap_committed_in_bytes
    jvm.mem.heap_max_in_bytes
    jvm.mem.non_heap_used_in_bytes
    jvm.mem.non_heap_committed_in_bytes
    jvm.gc.collectors.young.collection_count
    jvm.gc.collectors.young.collection_time_in_millis
    jvm.gc.collectors.old.collection_count
    jvm.gc.collectors.old.collection_time_in_millis
    thread_pool.bulk.queue
    thread_pool.bulk.active
    thread_pool.bulk.largest
    thread_pool.write.queue
    thread_pool.write.active
    thread_pool.write.largest
    thread_pool.search.queue
    thread_pool.search.active
    thread_pool.search.largest
    thread_pool.get.queue
    thread_pool.get.active
    thread_pool.get.largest
    os.cpu.percent
    os.cpu.load_average.1m
    os.cpu.load_average.5m
    os.cpu.load_average.15m
    fs.total.free_in_bytes
    fs.total.available_in_bytes
    fs.total.total_in_bytes
    indices.query_cache.memory_size_in_bytes
    indices.fielddata.memory_size_in_bytes
    indices.request_cache.memory_size_in_bytes
    indices.segments.count
    indices.segments.memory_in_bytes
    indices.store.size_in_bytes
    thread_pool.ccr.active
    thread_pool.ccr.queue
    thread_pool.ccr.largest
    thread_pool.ccr.threads
    thread_pool.index.active
    thread_pool.index.queue
    thread_pool.index.largest
    thread_pool.index.threads
    thread_pool.ml_autodetect.active
    thread_pool.ml_autodetect.queue
    thread_pool.ml_autodetect.largest
    thread_pool.ml_autodetect.threads
    thread_pool.ml_datafeed.active
    thread_pool.ml_datafeed.queue
    thread_pool.ml_datafeed.largest
    thread_pool.ml_datafeed.threads
    thread_pool.ml_utility.active
    thread_pool.ml_utility.queue
    thread_pool.ml_utility.largest
    thread_pool.ml_utility.threads
    thread_pool.rollup_indexing.active
    thread_pool.rollup_indexing.queue
    thread_pool.rollup_indexing.largest
    thread_pool.rollup_indexing.threads
    thread_pool.security-token-key.active
    thread_pool.security-token-key.queue
    thread_pool.security-token-key.largest
    thread_pool.security-token-key.threads
    thread_pool.watcher.active
    thread_pool.watcher.queue
    thread_pool.watcher.largest
    thread_pool.watcher.threads
""".split()

INDEX_RATE = """
    total.indexing.index_total
    total.indexing.index_time_in_millis
    total.indexing.delete_total
    total.indexing.delete_time_in_millis
    total.indexing.noop_update_total
    total.indexing.throttle_time_in_millis
    total.search.query_total
    total.search.query_time_in_millis
    total.search.fetch_total
    total.search.fetch_time_in_millis
    total.search.scroll_total
    total.search.scroll_time_in_millis
    total.get.total
    total.get.time_in_millis
    total.get.exists_total
    total.get.exists_time_in_millis
    total.get.missing_total
    total.get.missing_time_in_millis
    total.refresh.total
    total.refresh.total_time_in_millis
    total.flush.total
    total.flush.total_time_in_millis
    total.merges.total
    total.merges.total_time_in_millis
    total.merges.total_docs
    total.merges.total_size_in_bytes
""".split()

INDEX_LATENCY = {
    "total.search.query_latency": ("total.search.query_time_in_millis", "total.search.query_total"),
    "total.indexing.index_latency": ("total.indexing.index_time_in_millis", "total.indexing.index_total"),
    "total.search.fetch_latency_ms": ("total.search.fetch_time_in_millis", "total.search.fetch_total"),
    "total.get.latency_ms": ("total.get.time_in_millis", "total.get.total"),
}

INDEX_MAX = """
    total.docs.count
    total.docs.deleted
    total.store.size_in_bytes
    primaries.store.size_in_bytes
    primaries.docs.count
    primaries.docs.deleted
    total.segments.count
    total.segments.memory_in_bytes
    primaries.segments.count
    total.query_cache.memory_size_in_bytes
    total.fielddata.memory_size_in_bytes
    total.request_cache.memory_size_in_bytes
""".split()

HEALTH_MAX = """
    number_of_nodes
    number_of_data_nodes
    active_primary_shards
    active_shards
    relocating_shards
    initializing_shards
    unassigned_shards
    delayed_unassigned_shards
    number_of_pending_tasks
    number_of_in_flight_fetch
    task_max_waiting_in_queue_millis
    active_shards_percent_as_number
""".split()

CLUSTER_MAX = """
    indices.count
    indices.docs.count
    indices.docs.deleted
    indices.store.size_in_bytes
    indices.fielddata.memory_size_in_bytes
    indices.fielddata.evictions
    indices.query_cache.memory_size_in_bytes
    indices.query_cache.total_count
    indices.query_cache.hit_count
    indices.query_cache.miss_count
    indices.query_cache.cache_count
    indices.query_cache.cache_size
    indices.query_cache.evictions
    indices.completion.size_in_bytes
    indices.segments.count
    indices.segments.memory_in_bytes
    indices.segments.terms_memory_in_bytes
    indices.segments.stored_fields_memory_in_bytes
    indices.segments.term_vectors_memory_in_bytes
    indices.segments.norms_memory_in_bytes
    indices.segments.points_memory_in_bytes
    indices.segments.doc_values_memory_in_bytes
    indices.segments.index_writer_memory_in_bytes
    indices.segments.version_map_memory_in_bytes
    indices.segments.fixed_bit_set_memory_in_bytes
    indices.shards.total
    indices.shards.primaries
    indices.shards.replication
    indices.shards.index.shards.min
    indices.shards.index.shards.max
    indices.shards.index.shards.avg
    indices.shards.index.primaries.min
    indices.shards.index.primaries.max
    indices.shards.index.primaries.avg
    indices.shards.index.replication.min
    indices.shards.index.replication.max
    indices.shards.index.replication.avg
    nodes.count.total
    nodes.count.data
    nodes.count.master
    nodes.count.ingest
    nodes.count.coordinating_only
    nodes.os.available_processors
    nodes.os.allocated_processors
    nodes.os.mem.total_in_bytes
    nodes.os.mem.free_in_bytes
    nodes.os.mem.used_in_bytes
    nodes.os.mem.free_percent
    nodes.os.mem.used_percent
    nodes.process.cpu.percent
    nodes.process.open_file_descriptors.min
    nodes.process.open_file_descriptors.max
    nodes.process.open_file_descriptors.avg
    nodes.jvm.max_uptime_in_millis
    nodes.jvm.mem.heap_max_in_bytes
    nodes.jvm.mem.heap_used_in_bytes
    nodes.jvm.threads
    nodes.fs.total_in_bytes
    nodes.fs.free_in_bytes
    nodes.fs.available_in_bytes
""".split()

SHARD_RATE = """
    stats.indexing.index_total
    stats.indexing.index_time_in_millis
    stats.indexing.delete_total
    stats.search.query_total
    stats.search.query_time_in_millis
    stats.search.fetch_total
""".split()

SHARD_LATENCY = {
    "stats.search.query_latency": ("stats.search.query_time_in_millis", "stats.search.query_total"),
    "stats.indexing.index_latency": ("stats.indexing.index_time_in_millis", "stats.indexing.index_total"),
}

SHARD_MAX = """
    stats.docs.count
    stats.store.size_in_bytes
""".split()
