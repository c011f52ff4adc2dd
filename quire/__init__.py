"""quire: document-corpus analytics as Spark jobs.

Every operator is a function from DataFrame to DataFrame (or a Column
expression); no session is created inside the package.
"""
