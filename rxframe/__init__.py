"""rxframe: registry, leaflet and retrieval tables as Spark DataFrame jobs.

Every public operator is a ``DataFrame -> DataFrame`` function; column names
are parameters and no function holds a global session.
"""

__version__ = "0.1.0"
