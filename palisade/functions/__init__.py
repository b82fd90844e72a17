"""Column functions: native expressions in ``native``, Arrow UDFs in ``udfs``."""
