r"""Sectioned ``;`` files as a data source of Spark, to be read and written by format.

    spark.dataSource.register(sectioned_source())
    rows.write.format("sectioned").mode("overwrite").save(folder)      # section, header, values
    spark.read.format("sectioned").load(folder)

A file has sections: a line ``section=name``, a line with the names of its columns, and lines of values, as many
as each section has. Every file of a folder is a partition of its own and is read line by line; every task writes its rows to files of its
own, one for each section, which get their names only when all tasks have succeeded. Folders are those of any
file system that Arrow knows by its address; a path without a scheme is local.

Defined cases: lines before the first section that begin with ``#`` are comments; short lines have fewer values; a value without
content is the empty text; line ends and separators in a value become blanks; a section that a task has no rows of isn't written by it; no files give no
rows; ``append`` adds files, ``overwrite`` removes the ones that stood there when all is written.
"""

from __future__ import annotations

SCHEMA = "section string, header array<string>, place long, values array<string>"


def sectioned_source():
    """The data source's class; it is made here so that it can be sent to tasks with all it needs."""
    import io
    import uuid

    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

    def place_of(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def listed(path: str) -> list[str]:
        from pyarrow import fs

        system, at = place_of(path)
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    class File(InputPartition):
        def __init__(self, name: str) -> None:
            self.name = name

    class Reader(DataSourceReader):
        def __init__(self, path: str) -> None:
            self.path = path

        def partitions(self):
            return [File(name) for name in listed(self.path)] or [File("")]

        def read(self, partition):
            if not partition.name:
                return
            system, _ = place_of(self.path)
            section, header, place = None, None, 0
            with system.open_input_file(partition.name) as raw:
                for line in io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8", newline="\n"):
                    line = line.rstrip("\n")
                    if line.startswith("section="):
                        section, header, place = line[8:], None, 0
                    elif section is not None and header is None:
                        header = line.split(";")
                    elif section is not None:
                        yield section, header, place, line.split(";")
                        place += 1

    class Written(WriterCommitMessage):
        def __init__(self, names: list[tuple[str, str]]) -> None:
            self.names = names

    class Writer(DataSourceWriter):
        def __init__(self, path: str, overwrite: bool) -> None:
            self.path = path
            self.before = listed(path) if overwrite else []

        def write(self, iterator):
            from pyspark import TaskContext

            system, at = place_of(self.path)
            system.create_dir(at, recursive=True)
            tag = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
            names, streams = [], {}
            clean = str.maketrans({c: " " for c in "\n\r\x0b\x0c\x85;"})
            for row in iterator:
                key = (row.section, tuple(row.header))
                if key not in streams:
                    name = f"part-{tag}-{len(streams):03d}.txt"
                    names.append((f"{at}/.{name}", f"{at}/{name}"))
                    streams[key] = system.open_output_stream(names[-1][0])
                    streams[key].write(f"section={row.section}\n{';'.join(row.header)}\n".encode())
                streams[key].write((";".join(("" if v is None else str(v)).translate(clean) for v in row["values"]) + "\n").encode())
            for stream in streams.values():
                stream.close()
            return Written(names)

        def commit(self, messages):
            system, at = place_of(self.path)
            for m in messages:
                for hidden, name in m.names if m else []:
                    system.move(hidden, name)
            for name in self.before:
                system.delete_file(name)

        def abort(self, messages):
            system, _ = place_of(self.path)
            for m in messages:
                for hidden, _ in m.names if m else []:
                    system.delete_file(hidden)

    class Sectioned(DataSource):
        @classmethod
        def name(cls):
            return "sectioned"

        def schema(self):
            return "section string, header array<string>, place long, values array<string>"

        def reader(self, schema):
            return Reader(self.options["path"])

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], overwrite)

    return Sectioned
