"""Payload schemas, enum catalogues and metric catalogues of the telemetry."""

# Fields of the JSON payloads, as Spark DDL.
TASK_STATES = [
    "total", "created", "scheduled", "deploying", "running", "finished",
    "canceling", "canceled", "failed", "reconciling", "initializing",
]
JOB_OVERVIEW = (
    "jobs ARRAY<STRUCT<jid: STRING, name: STRING, state: STRING, `start-time`: BIGINT, `end-time`: BIGINT, "
    "`last-modification`: BIGINT, tasks: STRUCT<" + ", ".join(f"{s}: INT" for s in TASK_STATES) + ">>>"
)
JOB_STATUS = "jobs ARRAY<STRUCT<id: STRING, status: STRING>>"
METRICS = "ARRAY<STRUCT<id: STRING, value: STRING>>"
CONFIG = "ARRAY<STRUCT<key: STRING, value: STRING>>"
CLUSTER_OVERVIEW = (
    "`flink-version` STRING, taskmanagers INT, `slots-total` INT, `slots-available` INT, "
    "`jobs-running` INT, `jobs-finished` INT, `jobs-cancelled` INT, `jobs-failed` INT"
)
MEMBER_IDS = "taskmanagers ARRAY<STRUCT<id: STRING>>"
_RESOURCE = (
    "STRUCT<cpuCores: FLOAT, taskHeapMemory: BIGINT, taskOffHeapMemory: BIGINT, "
    "managedMemory: BIGINT, networkMemory: BIGINT>"
)
MEMBER_DETAIL = (
    "id STRING, path STRING, dataPort INT, slotsNumber INT, freeSlots INT, "
    f"totalResource {_RESOURCE}, freeResource {_RESOURCE}, "
    "hardware STRUCT<cpuCores: FLOAT, physicalMemory: BIGINT, freeMemory: BIGINT, managedMemory: BIGINT>, "
    "memoryConfiguration STRUCT<frameworkHeap: BIGINT, taskHeap: BIGINT, frameworkOffHeap: BIGINT, "
    "taskOffHeap: BIGINT, networkMemory: BIGINT, managedMemory: BIGINT, jvmMetaspace: BIGINT, "
    "jvmOverhead: BIGINT, totalFlinkMemory: BIGINT, totalProcessMemory: BIGINT>"
)
OP_STATUS = "status STRUCT<id: STRING>, operation STRUCT<`failure-cause`: STRUCT<`stack-trace`: STRING>>"
POD_USAGE = (
    "timestamp STRING, containers ARRAY<STRUCT<name: STRING, usage: STRUCT<cpu: STRING, memory: STRING>>>"
)
CHANGE_EVENT = "op STRING, kind STRING, scope STRING, seq BIGINT, object STRING"
CONDITIONS = (
    "ARRAY<STRUCT<type: STRING, status: STRING, reason: STRING, message: STRING, lastTransitionTime: STRING>>"
)
_METADATA = (
    "STRUCT<name: STRING, namespace: STRING, creationTimestamp: STRING, labels: MAP<STRING, STRING>>"
)
SERVICE_OBJECT = (
    f"metadata {_METADATA}, spec STRUCT<clusterIP: STRING, selector: MAP<STRING, STRING>, "
    "ports: ARRAY<STRUCT<name: STRING, protocol: STRING, port: INT, targetPort: STRING>>>"
)
DEPLOYMENT_OBJECT = (
    f"metadata {_METADATA}, spec STRUCT<selector: STRUCT<matchLabels: MAP<STRING, STRING>>>, "
    "status STRUCT<observedGeneration: BIGINT, replicas: INT, readyReplicas: INT, unavailableReplicas: INT, "
    f"availableReplicas: INT, updatedReplicas: INT, conditions: {CONDITIONS}>"
)
POD_OBJECT = (
    f"metadata {_METADATA}, spec STRUCT<nodeName: STRING, containers: ARRAY<STRUCT<name: STRING, "
    "resources: STRUCT<limits: MAP<STRING, STRING>, requests: MAP<STRING, STRING>>>>>, "
    f"status STRUCT<phase: STRING, reason: STRING, hostIP: STRING, podIP: STRING, startTime: STRING, "
    f"conditions: {CONDITIONS}, containerStatuses: ARRAY<STRUCT<name: STRING, image: STRING, ready: BOOLEAN, "
    "restartCount: INT, state: STRUCT<running: STRUCT<startedAt: STRING>, "
    "waiting: STRUCT<message: STRING, reason: STRING>, terminated: STRUCT<exitCode: INT, message: STRING, "
    "reason: STRING, signal: INT, startedAt: STRING, finishedAt: STRING>>>>>"
)

# Enum names in order of declaration; the position is the ordinal.
JOB_STATES = [
    "INITIALIZING", "CREATED", "RUNNING", "FAILING", "FAILED", "CANCELLING",
    "CANCELED", "FINISHED", "RESTARTING", "SUSPENDED", "RECONCILING",
]
EXEC_MODES = ["kubernetes-application", "kubernetes-session", "Unknown"]
OP_STATES = ["COMPLETED", "IN_PROGRESS"]
POD_PHASES = ["Pending", "Running", "Succeeded", "Failed", "Unknown"]
CONDITION_STATUSES = ["True", "False", "Unknown"]
QUANTITY_UNITS = ["n", "u", "m", "k", "M", "G", "T", "P", "E", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei"]
LOG_LEVELS = ["TRACE", "DEBUG", "INFO", "WARNING", "ERROR", "FATAL"]
CHANGE_OPS = ["Reseted", "Added", "Modified", "Deleted"]

# Raw metric keys of a job.
JOB_METRIC_KEYS = [
    "cancellingTime",
    "createdTime",
    "deployingTime",
    "downtime",
    "failingTime",
    "fullRestarts",
    "initializingTime",
    "lastCheckpointDuration",
    "lastCheckpointFullSize",
    "lastCheckpointPersistedData",
    "lastCheckpointProcessedData",
    "lastCheckpointRestoreTimestamp",
    "lastCheckpointSize",
    "numberOfCompletedCheckpoints",
    "numberOfFailedCheckpoints",
    "numberOfInProgressCheckpoints",
    "restartingTime",
    "runningTime",
    "totalNumberOfCheckpoints",
    "uptime",
]

# Raw metric keys of a coordinator.
COORDINATOR_METRIC_KEYS = [
    "Status.JVM.CPU.Load",
    "Status.JVM.CPU.Time",
    "Status.JVM.ClassLoader.ClassesLoaded",
    "Status.JVM.ClassLoader.ClassesUnloaded",
    "Status.JVM.GarbageCollector.Copy.Count",
    "Status.JVM.GarbageCollector.Copy.Time",
    "Status.JVM.GarbageCollector.MarkSweepCompact.Count",
    "Status.JVM.GarbageCollector.MarkSweepCompact.Time",
    "Status.JVM.Memory.Direct.Count",
    "Status.JVM.Memory.Direct.MemoryUsed",
    "Status.JVM.Memory.Direct.TotalCapacity",
    "Status.JVM.Memory.Heap.Committed",
    "Status.JVM.Memory.Heap.Max",
    "Status.JVM.Memory.Heap.Used",
    "Status.JVM.Memory.Mapped.Count",
    "Status.JVM.Memory.Mapped.MemoryUsed",
    "Status.JVM.Memory.Mapped.TotalCapacity",
    "Status.JVM.Memory.Metaspace.Committed",
    "Status.JVM.Memory.Metaspace.Max",
    "Status.JVM.Memory.Metaspace.Used",
    "Status.JVM.Memory.NonHeap.Committed",
    "Status.JVM.Memory.NonHeap.Max",
    "Status.JVM.Memory.NonHeap.Used",
    "Status.JVM.Threads.Count",
    "numPendingTaskManagers",
    "numRegisteredTaskManagers",
    "numRunningJobs",
    "startWorkFailurePerSecond",
    "taskSlotsAvailable",
    "taskSlotsTotal",
]

# Raw metric keys of a worker.
WORKER_METRIC_KEYS = [
    "Status.Flink.Memory.Managed.Total",
    "Status.Flink.Memory.Managed.Used",
    "Status.JVM.CPU.Load",
    "Status.JVM.CPU.Time",
    "Status.JVM.ClassLoader.ClassesLoaded",
    "Status.JVM.ClassLoader.ClassesUnloaded",
    "Status.JVM.GarbageCollector.G1_Old_Generation.Count",
    "Status.JVM.GarbageCollector.G1_Old_Generation.Time",
    "Status.JVM.GarbageCollector.G1_Young_Generation.Count",
    "Status.JVM.GarbageCollector.G1_Young_Generation.Time",
    "Status.JVM.Memory.Direct.Count",
    "Status.JVM.Memory.Direct.MemoryUsed",
    "Status.JVM.Memory.Direct.TotalCapacity",
    "Status.JVM.Memory.Heap.Committed",
    "Status.JVM.Memory.Heap.Max",
    "Status.JVM.Memory.Heap.Used",
    "Status.JVM.Memory.Mapped.Count",
    "Status.JVM.Memory.Mapped.MemoryUsed",
    "Status.JVM.Memory.Mapped.TotalCapacity",
    "Status.JVM.Memory.Metaspace.Committed",
    "Status.JVM.Memory.Metaspace.Max",
    "Status.JVM.Memory.Metaspace.Used",
    "Status.JVM.Memory.NonHeap.Committed",
    "Status.JVM.Memory.NonHeap.Max",
    "Status.JVM.Memory.NonHeap.Used",
    "Status.JVM.Threads.Count",
    "Status.Network.AvailableMemorySegments",
    "Status.Network.TotalMemorySegments",
    "Status.Shuffle.Netty.AvailableMemory",
    "Status.Shuffle.Netty.AvailableMemorySegments",
    "Status.Shuffle.Netty.RequestedMemoryUsage",
    "Status.Shuffle.Netty.TotalMemory",
    "Status.Shuffle.Netty.TotalMemorySegments",
    "Status.Shuffle.Netty.UsedMemory",
    "Status.Shuffle.Netty.UsedMemorySegments",
]

# Metric keys that hold a fraction; all others hold a whole number.
DOUBLE_METRIC_KEYS = ["Status.JVM.CPU.Load", "startWorkFailurePerSecond"]

# Labels that mark the objects of a cluster.
MAIN_CONTAINER = "flink-main-container"
APP_LABEL = "app"
COMPONENT_LABEL = "component"
TYPE_LABEL = "type"
NATIVE_TYPE = "flink-native-kubernetes"
REST_SUFFIX = "-rest"
REST_PORT_NAME = "rest"
REST_PORT = 8081

# Configuration keys that users may not set themselves.
FORBIDDEN_CONFIG_KEYS = [
    "execution.target",
    "kubernetes.cluster-id",
    "kubernetes.namespace",
    "kubernetes.container.image",
    "kubernetes.service-account",
    "kubernetes.jobmanager.service-account",
    "kubernetes.pod-template-file",
    "kubernetes.pod-template-file.taskmanager",
    "kubernetes.pod-template-file.jobmanager",
    "$internal.deployment.config-dir",
    "pipeline.jars",
    "$internal.application.main",
    "$internal.application.program-args",
]

# Configuration keys whose values are hidden.
PROTECTED_CONFIG_KEYS = [
    "hive.s3.aws-secret-key",
    "fs.s3a.secret.key",
    "s3.secret-key",
    "exec.mode",
    "deploy.source",
]

# Schemes of object store paths.
OBJECT_STORE_SCHEMES = ["s3", "s3a", "s3n", "s3p"]
