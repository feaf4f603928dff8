"""Transit timetable analytics as PySpark DataFrame jobs."""
