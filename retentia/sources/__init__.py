"""Sources: file scans with the reference's reader semantics, typed loaders, and
adapters that turn the driver's parquet tables into operator inputs."""
