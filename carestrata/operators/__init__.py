"""Operators: DataFrames in, one lazy DataFrame out. Only ``ingest.record`` runs an action (it writes).

All joins lean on the references the tables declare (``carestrata.schema``): a child row's parent
exists, because ``carestrata.operators.ingest`` lets no other row in. That is what allows a top-k
before the join that decorates it, and counting children without visiting the parent table.
"""
