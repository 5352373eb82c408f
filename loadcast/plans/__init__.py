"""Plans: end-to-end forecasters (``forecast``), the scoring run (``score``),
the registered queries (``queries``), their DuckDB twins (``oracle``) and the
parameters of both (``params``)."""
