"""caseflow: the data side of a multi-tenant service business as Spark jobs.

Every public function takes DataFrames and returns DataFrames built from
native Spark expressions; nothing is collected to the driver.
"""

__version__ = "0.1.0"
