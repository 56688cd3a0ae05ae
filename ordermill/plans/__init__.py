"""The marts and the jobs that land tables and write marts."""
